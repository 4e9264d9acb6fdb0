"""HTML extraction and WARC archives: wrappers, round trips and edge cases."""

import hashlib
import html
import random
import re

import pytest
import zstandard
from gridfolio.llm import html_extract as H
from gridfolio.llm import warc
from gridfolio.session import scratch_path
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "page_id long, url string, html string"


def page(title, paragraphs, menu="Home", article=True, extra=""):
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    body = f"<article>{body}</article>" if article else f'<div class="content">{body}</div>'
    return (
        f'<html><head><title>{title}</title><style>p{{}}</style></head><body><header>Site name</header><nav><ul><li><a href="/">{menu}</a></li></ul></nav>'
        f'<div class="cookie-notice">We use cookies.</div>{body}<section class="comments"><p>Nice post!</p></section><aside>Side</aside>{extra}'
        '<form><label>Mail</label></form><footer>&copy; 2024</footer><script>if (a < b) { x("</p>") }</script></body></html>'
    )


def test_article_is_extracted(spark):
    rows = [(1, "http://a.org/1", page("T &amp; U", ["One  <b>bold</b> text.<br>More", "", "Two &lt;3"]))]
    got = H.extract(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["text"] == "T & U\n\nOne bold text. More\n\nTwo <3" and got["n_chars"] == len(got["text"])


def test_hidden_and_marked_blocks_go(spark):
    inside = '<p>Keep.</p><div style="display: none">no</div><div hidden>no</div><div class="share-buttons">no</div><div role="alert">no</div><p>And keep.</p>'
    rows = [(1, "http://a.org/1", f"<body><main>{inside}</main><div class='related'><article><p>no</p></article></div></body>")]
    assert H.extract(spark.createDataFrame(rows, SCHEMA)).first()["text"] == "Keep.\n\nAnd keep."


def test_a_class_of_the_layout_does_not_hide_the_article():
    _, found = H.leaves("<body><div class='with-sidebar'><article><p>text</p></article><aside>no</aside></div></body>")
    assert H.main_text(found, H.Template()) == "text"


def test_unmarked_pages_use_the_hosts_wrapper(spark):
    rows = [(i, "http://b.org/x", page(f"Title {i}", [f"Paragraph {i} of this page says something.", f"And {i} more words follow here."], article=False, extra="<div class=box><p>Call us now for an offer</p></div>")) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "Title 3\n\nParagraph 3 of this page says something.\n\nAnd 3 more words follow here."


def test_constants_inside_articles_go(spark):
    notice = "<div class=box>Tell your friends about this page.</div>"
    rows = [(i, "http://d.org/x", f"<body><article><h1>Title {i}</h1><p>Paragraph {i} says something.</p>{notice if i else ''}<ul><li>Item {i}</li></ul></article></body>") for i in range(6)]
    rows += [(10 + i, "http://e.org/x", f"<body><p>{i}</p><article><h1>One</h1><p>copied article</p></article></body>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"Title {i}\n\nParagraph {i} says something.\n\nItem {i}" for i in range(6))
    assert all(got[10 + i] == "One\n\ncopied article" for i in range(6))


def test_teasers_are_not_the_article():
    teasers = "".join(f'<article><a href="/{i}">Another story {i}</a></article>' for i in range(3))
    _, found = H.leaves(f'<body><article><p>The text, <a href="/x">linked</a> in part.</p><p><a href="/y">More</a></p></article><div>{teasers}</div></body>')
    assert H.main_text(found, H.Template()) == "The text, linked in part.\n\nMore"
    _, found = H.leaves(f"<body>{teasers}</body>")
    assert H.main_text(found, H.Template()).count("Another story") == 3


def test_generated_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        plain[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in H.extract(pages).collect()} == plain


def test_wrapper_has_repeats_optionals_and_slots():
    a = H.page_wrapper(*H.leaves("<body><h1>A</h1><p>x</p><p>y</p><p>z</p><div>Same</div></body>"))
    b = H.page_wrapper(*H.leaves("<body><h1>B</h1><p>only</p><ul><li>extra</li></ul><div>Same</div></body>"))
    w = H.align(a, b)
    assert "".join(map(H._signature, w)) == "<body><h1>#</h1>(<p>#</p>)+[<ul><li>#</li></ul>]?<div>#</div></body>"
    assert "".join(map(H._signature, H.align(w, a))) == "".join(map(H._signature, w))


def renamed(page):
    """The page with nothing but div elements, without classes; menus stay links."""
    return re.sub(r"<(/?)(?:article|nav|header|footer|aside|section|main|p|h1|ul|li|form|label)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))


def test_wrappers_decide_where_all_tags_are_alike(spark):
    rows, want = [], {}
    for i in range(40):
        paragraphs = [f"Paragraph {k} of page {i} tells {'at some length ' * (i % 7)}what happened." for k in range(1 + i % 5)]
        extra = "<div>Call us now for an offer that ends today, dear reader of this site</div>" if i % 3 else ""
        rows.append((i, "http://r.org/x", renamed(page(f"Title number {i}", paragraphs, extra=extra))))
        want[i] = "\n\n".join([f"Title number {i}", *paragraphs])
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_generated_pages_without_article_markup(spark):
    """Nothing on these pages is constant, so only the regions of the wrappers tell the article."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    alike = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<(/?)(?:article|section|main)[^>]*>", "<$1div>"), ' class="(?!ad)[^"]*"', ""))
    got = {r["page_id"]: r["text"] for r in H.extract(alike).collect()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.97 * len(want)


def test_a_text_counts_once_a_page_and_copies_once(spark):
    own = [f"<body><p>same</p><div>a text of its own number {i}</div></body>" for i in range(3)]
    lacks = "<body><p>else</p><div>a text of its own</div></body>"
    rows = [(i, "http://one.org", "<body><p>same</p><p>same</p><p>same</p><div>other text</div></body>") for i in range(4)]
    rows += [(10 + i, "http://three.org", h) for i, h in enumerate(own)] + [(20 + i, "http://four.org", h) for i, h in enumerate([own[0], lacks, *own[1:]])]
    found = {r["host"]: H.loaded(r["wrapper"]) for r in H.infer(spark.createDataFrame(rows, SCHEMA)).collect()}
    same = H.place_key(H.leaves(own[0])[1][0])
    # Copies of a page and repeats on it count once, and a page that lacks the constant doesn't hide it.
    assert not found["one.org"].constants and found["three.org"].constants == found["four.org"].constants == {same}
    assert found["three.org"].firm == {same}


def test_result_does_not_depend_on_partitions(spark):
    rows = [(i, "http://q.org/x", f"<body><div>Menu of the site</div><div><h2>Title {i}</h2><div>Text {i} is here.{' More.' * (i % 4)}</div></div><div>{'Bye' if i % 5 else 'See you'}</div></body>") for i in range(30)]
    rows += [(100 + i, "http://q.org/copy", rows[0][2]) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    results = [sorted(map(str, H.extract(df.repartition(n, "page_id")).collect())) for n in (1, 4, 7)]
    assert results[0] == results[1] == results[2]
    assert "Title 0\n\nText 0 is here." in {r["text"] for r in H.extract(df).collect() if r["page_id"] >= 100}


def test_partial_wrappers_are_aligned_in_rounds(spark, monkeypatch):
    rows = [(i, "http://q.org/x", f"<body><div>Menu of the site</div><div><h2>Title {i}</h2><div>Text {i} is here.{ ' More.' * (i % 4)}</div></div></body>") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(12, "page_id")
    want = sorted(map(str, H.extract(df).collect()))
    monkeypatch.setattr(H, "FAN_IN", 2)
    assert sorted(map(str, H.extract(df).collect())) == want


def test_long_pages_are_aligned_in_bounds(monkeypatch):
    a = [str(i) for i in range(300)]
    b = [x for x in a if int(x) % 7] + ["x"]
    want = H._longest(a, b)
    monkeypatch.setattr(H, "CELLS", 100)
    assert H._matches(a, b) == want
    assert H._matches(["y"] * 50, ["z"] * 50) == []


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ("<html><head><title>x</title><body><p>text</p>", "text"), ("<p>a <svg/> b</p>", "a b"), ("<p>a</p><select><option>no<p>text</p>", "a\n\ntext"),
        ("<p>a <svg><text>no</text></svg> b</p>", "a b"), ("<p>a</p><object data=x><p>b</p>", "a\n\nb"),
    ],
)
def test_missing_end_tags_do_not_swallow_the_page(raw, text):
    _, found = H.leaves(raw)
    assert H.main_text(found, H.Template()) == text


@pytest.mark.parametrize("raw", ["", "<", "<p", "<p>a<div>b", "</p></div>", "<!-- open", "<script>x", "&am", "a & b", "<p>&amp;lt;</p>", '<p title="a>b">c</p>', "<table><tr><td>1<td>2</table>", "<article></article>", "\x00<p> x</p>"])
def test_broken_pages_do_not_fail(raw):
    stream, found = H.leaves(raw)
    assert stream.count("#") == len(found)
    H.align(H.page_wrapper(stream, found), H.page_wrapper(*H.leaves("<body><p>x</p></body>")))


def test_extraction_edges(spark):
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    rows = [(1, None, None), (2, "http://c.org", ""), (None, "x", "<article><p>t</p></article>"), (4, "http://c.org", long), (5, "http://c.org", "<p>a</p>"), (5, "http://c.org", "<p>a</p>")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("host", "wrapper", "text", "n_chars")})
    got = sorted(str((r["page_id"], r["text"][:9], r["n_chars"])) for r in H.extract(df).collect())
    assert got == sorted(map(str, [(1, "", 0), (2, "", 0), (None, "t", 1), (4, "word\n\nwor", 6 * 30_000 - 2), (5, "a", 1), (5, "a", 1)]))
    assert H.extract(df.limit(0)).count() == 0


def brute_records(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        first = max(same, default=None) if len(data) >= 1000 else None
        revisit = first is not None and first != i
        out.append(str((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None)))
    return sorted(out)


BIG = "ü" * 700


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b\n", BIG), (2, None, BIG), (9, "u", BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", BIG), (9, "u", BIG), (7, "u", "<p>\r\n\r\n</p>" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in warc.archive_round_trip(df).collect())
    assert got == brute_records(rows)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_seek_table_points_at_frames(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 400) for i in range(60)], SCHEMA)
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(df, folder, bundle_bytes=40_000)
    assert warc.fetch(manifest, 17) == [("page 17 " * 400).encode()]
    name = manifest.first()["bundle"]
    files, path = warc._filesystem(name)
    with files.open_input_file(path) as f:
        table = warc.seek_table(f)
        f.seek(0)
        whole = f.read()
    assert sum(n for _, _, n in table) == len(b"".join(zstandard.ZstdDecompressor().decompress(whole[a : a + p], max_output_size=n) for a, p, n in table))
    assert manifest.count() == 60 and manifest.select("bundle").distinct().count() > 1


def test_frames_hold_whole_records():
    w = warc.BundleWriter(frame_bytes=1000)
    places = [w.add(b"x" * n) for n in (400, 400, 400, 5000, 10)]
    assert places == [(0, 0), (0, 400), (1, 0), (2, 0), (3, 0)]


def notices(n, every):
    """Pages of one host, each ``every``th with the same notice inside its article, in an element that nothing else is in."""
    rows = []
    for i in range(n):
        paragraphs = [f"Paragraph {k} of page {i} tells what happened on day {i * 7 + k}." for k in range(1 + i % 3)]
        if i % every == 0:
            paragraphs[0] += "</p><div>Subscribe today to our letter, dear reader, and pay nothing for a month.</div><p>More"
        rows.append((i, "http://n.org/x", page(f"Title number {i}", paragraphs)))
    return rows


def test_constants_do_not_depend_on_the_order_of_pages(spark):
    """However rare a notice is and in whatever order pages are read, three pages that have it make it constant."""
    rows = notices(1000, 25)
    want = None
    for seed in range(10):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, SCHEMA).repartition(1 + seed % 4)
        got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
        assert not any("Subscribe" in t for t in got.values())
        want = want or got
        assert got == want


def test_constants_need_three_different_pages(spark):
    rows = notices(60, 30)
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame([*rows, *rows[:1] * 5], SCHEMA)).collect()}
    assert sum("Subscribe" in t for t in got.values()) == 2


def test_passages_that_articles_share_stay(spark):
    """A paragraph that a third of a host's articles have is no part of its template; one that nearly all have is."""
    rows, want = [], {}
    for i in range(60):
        paragraphs = [f"Paragraph of page {i}, which is its own.", *["A passage that many articles quote in full."] * (i % 3 == 0)]
        rows.append((i, "http://q.org/x", page(f"Title number {i}", [*paragraphs, *["Share this with your friends."] * (i % 10 > 0)])))
        want[i] = "\n\n".join([f"Title number {i}", *paragraphs])
    assert {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_wrappers_that_are_joined_give_the_same_texts(spark, monkeypatch):
    rows = [*notices(60, 5), *[(1000 + i, f"http://h{i % 7}.org/", page(f"T {i}", [f"Text {i} of a page."])) for i in range(40)], (None, None, "<p>a</p>")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, H.extract(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(map(str, H.extract(df).collect())) == want


def test_long_groups_are_folded():
    """A repeat of any width: here of thirty cells a row, with a text after each row."""
    row = ["<tr>", *["<td>", "#", "</td>", "<td>", "<b>", "#", "</b>", "</td>"] * 15, "</tr>", "#"]
    assert H._shortest_repeat(["<td>", "#", "</td>"] * 2) == 3
    wide = ["<table>", *["<tr>", *[f"<c{k}>" if j else f"</c{k}>" for k in range(40) for j in (1, 0)], "</tr>"] * 3, "</table>"]
    assert H._shortest_repeat(wide) == 82
    nodes = [["x", 1, []] if t == "#" else ["t", t] for t in row * 4]
    assert "".join(map(H._signature, H.fold(nodes))) == "(<tr>(<td>#</td><td><b>#</b></td>)+</tr>#)+"


def slow_repeat(signs):
    """The same by trying every width at every place."""
    for width in range(1, len(signs) // 2 + 1):
        for i in range(len(signs) - 2 * width + 1):
            group = signs[i : i + width]
            if H._opens(group[0]) and group == signs[i + width : i + 2 * width] and H._balanced(group):
                return width
    return 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<a>", "</a>", "<b>", "</b>", "#", "(<a>#</a>)+"]), max_size=14))
def test_shortest_repeats_equal_all_widths(signs):
    assert H._shortest_repeat(signs) == slow_repeat(signs)
