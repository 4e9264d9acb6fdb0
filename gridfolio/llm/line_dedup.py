"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only."""

from __future__ import annotations

from itertools import chain, repeat

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfolio.llm.text import hot_join, spread_left_join
from gridfolio.session import written

#: Leading tokens below the token count in the tree.
DEPTH = 3
#: Lines of fewer tokens have no variable fields: they are their own template.
MIN_TOKENS = 5
#: Lines of a leaf are of one template if at most this many of ten tokens differ.
DIFFERENT = 3
#: Bytes of line numbers and hashes that may be broadcast to the documents; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes that one line to read again, or one document's list of lines, takes at most when broadcast besides the numbers.
LINE_BYTES = 64
#: First open forms of a segment that the others are compared with, round by round; the last number holds for all further rounds.
FIRSTS = (1, 8, 64)
_BLANKS = " \t\r\f\x0b"
_BLANK = f"[{_BLANKS}]+"
_ANY = "<*>"


def _masked(line: Column) -> Column:
    """The tokens of a line; those of a long one that have a digit are variable fields."""
    tokens = F.array_remove(F.split(line, _BLANK), "")
    masked = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(_ANY)).otherwise(t))
    return F.when(line.rlike("[0-9]") & (F.size(tokens) >= MIN_TOKENS), masked).otherwise(tokens)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pos, leaf, form, long of the lines that have a token, of documents with an id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    # The same as _masked, step by step: fields with digits are replaced in the line, which then is split once.
    rows = rows.where("doc_id is not null").select("doc_id", "pos", F.btrim("line", F.lit(_BLANKS)).alias("line")).where("line <> ''")
    fields = F.regexp_replace("line", f"[^{_BLANKS}]*[0-9][^{_BLANKS}]*", _ANY)
    rows = rows.withColumn("masked", F.when(F.col("line").rlike("[0-9]"), fields).otherwise(F.col("line"))).withColumn("t", F.split("masked", _BLANK))
    own = (F.size("t") >= MIN_TOKENS) | (F.col("masked") == F.col("line"))
    rows = rows.select("doc_id", "pos", F.when(own, F.col("t")).otherwise(F.split("line", _BLANK)).alias("tokens"))
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH))
    return rows.select("doc_id", "pos", leaf.alias("leaf"), F.xxhash64("tokens").alias("form"), (F.size("tokens") >= MIN_TOKENS).alias("long"))


def _cuts(tokens: Column) -> Column:
    """Hashes of the segments of a line's tokens behind the leading ones, one more than tokens may differ.

    Two lines that differ in no more tokens have a segment in common, whichever tokens those are.
    """
    n = F.size(tokens)
    parts = F.floor(n * DIFFERENT / 10).cast("int") + 1
    rest = n - DEPTH
    edge = lambda i: (DEPTH + F.floor(rest * i / parts)).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.xxhash64(i, F.slice(tokens, edge(i) + 1, edge(i + 1) - edge(i))))


def _tokens(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """leaf, form, rank, tokens of one line (doc_id, pos) of each form; only these lines are read again.

    rank is a number that orders the forms by their first document and place there.
    """
    by_doc = written(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "leaf", "form")).alias("want")), "wanted-lines")
    size = (by_doc.agg(F.sum(F.size("want"))).first()[0] or 0) * LINE_BYTES
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = texts.where("doc_id is not null")
    named = named.join(F.broadcast(by_doc), "doc_id") if size <= BROADCAST_BYTES else spread_left_join(named, by_doc, "doc_id").where("want is not null")
    rows = named.withColumn("parts", F.split("text", "\n"))
    rows = rows.select("doc_id", "parts", F.explode("want").alias("w")).select("doc_id", "w.*", F.get("parts", F.col("w.pos")).alias("line"))
    # A repeated id may have another text at this place; the hash tells whether it is the line. Rows of one text give it twice.
    rows = rows.select("doc_id", "pos", "leaf", "form", _masked(F.col("line")).alias("tokens")).where(F.xxhash64("tokens") == F.col("form"))
    # Unlike a struct, a decimal fits the buffers of hash aggregation. Its last part tells forms apart that share id and place.
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    place = (F.col("doc_id").cast("decimal(38,0)") * big(2**31) + F.col("pos")).cast("decimal(38,0)")
    rank = (place * big(2**31) + F.pmod("form", F.lit(2**31))).cast("decimal(38,0)")
    return rows.select("leaf", "form", rank.alias("rank"), "tokens").dropDuplicates(["leaf", "form"])


def _segments(forms: DataFrame) -> DataFrame:
    return forms.select("leaf", "rank", F.explode(_cuts(F.col("tokens"))).alias("cut"))


def _earlier(segments: DataFrame, firsts: DataFrame) -> DataFrame:
    """leaf, rank, first, beyond of the forms that come behind one of the ``firsts`` (leaf, cut, firsts, n) of a segment of theirs.

    beyond tells whether a form comes behind all of these in a segment, so that others may come before it too.
    """
    firsts = written(firsts, "line-segments")
    total = firsts.agg(F.sum("n")).first()[0] or 0
    met = hot_join(segments, firsts, ["leaf", "cut"], "n", total)
    before = F.explode(F.filter("firsts", lambda x: x < F.col("rank"))).alias("first")
    rows = met.select("leaf", "rank", before, (F.col("rank") > F.element_at("firsts", -1)).alias("beyond"))
    return written(rows.groupBy("leaf", "rank", "first").agg(F.max("beyond").alias("beyond")), "line-pairs")


def _first_forms(segments: DataFrame, most: int) -> DataFrame:
    """leaf, cut, firsts, n of the segments that several forms have: the ranks of the first ``most`` of them, and their number."""
    by, n = ["leaf", "cut"], F.count(F.lit(1)).alias("n")
    if most == 1:
        return segments.groupBy(*by).agg(F.array(F.min("rank")).alias("firsts"), n).where("n > 1")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rank"))
    few = segments.withColumn("place", place).where(F.col("place") <= most).groupBy(*by).agg(F.sort_array(F.collect_list("rank")).alias("firsts"))
    return segments.groupBy(*by).agg(n).where("n > 1").join(few, by).select(*by, "firsts", "n")


def _alike(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """leaf, rank, first of the pairs of forms that differ in few enough tokens."""
    own = forms.select("leaf", "rank", F.col("tokens").alias("own"))
    other = forms.select("leaf", F.col("rank").alias("first"), F.col("tokens").alias("other"))
    # Very many forms may look at one first form, which is then a hot key.
    firsts = pairs.groupBy("leaf", "first").agg(F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.join(other, ["leaf", "first"]), "line-firsts")
    compared = hot_join(pairs.select("leaf", "rank", "first"), firsts, ["leaf", "first"], "n", pairs.count()).join(own, ["leaf", "rank"])
    differ = F.size(F.filter(F.zip_with("own", "other", lambda a, b: a != b), lambda x: x))
    return written(compared.where(differ * 10 <= F.size("own") * DIFFERENT).select("leaf", "rank", "first"), "line-alike")


def _late(forms: DataFrame, late: DataFrame) -> DataFrame:
    """leaf, rank, first of all forms that are alike to one of the ``late`` forms before them."""
    by, n = ["leaf", "cut"], F.count(F.lit(1)).alias("n")
    leaves = written(forms.groupBy("leaf").agg(n).join(late.select("leaf").distinct(), "leaf"), "late-leaves")
    total = leaves.agg(F.sum("n")).first()[0] or 0
    own = written(_segments(hot_join(forms, leaves, "leaf", "n", total)), "late-segments")
    begins = _segments(late).groupBy(*by).agg(F.sort_array(F.collect_list("rank")).alias("firsts"))
    return _alike(_earlier(own, own.groupBy(*by).agg(n).join(begins, by).select(*by, "firsts", "n")), forms)


def _groups(forms: DataFrame) -> DataFrame:
    """leaf, rank, root of the forms that are in a group; root is the rank of the form that the group begins with.

    In the order of ranks, a form joins the earliest form of its leaf that begins a group and differs from it in few enough
    tokens, or begins one if there is none. Forms that may be alike have a segment in common. In each round the open forms
    are compared with the first few open ones of each of their segments: those that turn out to have none before them that is alike
    begin groups, and those that are alike to such a one are in a group. Forms that still wait for others go to the next round, so that
    none is left out; most leaves have none after the first. Groups that begin later may have earlier beginnings than those that
    forms have joined already, so all forms are compared with these once more.
    """
    left, late, found = forms, None, None
    for most in chain(FIRSTS, repeat(FIRSTS[-1])):
        segments = _segments(left)
        pairs = _earlier(segments, _first_forms(segments, most))
        alike = _alike(pairs, left)
        waiting = written(alike.select("leaf", "rank").union(pairs.where("beyond").select("leaf", "rank")).distinct(), "line-waiting")
        begins = alike.groupBy("leaf", "first").agg(F.count(F.lit(1)).alias("n")).join(waiting.withColumnRenamed("rank", "first"), ["leaf", "first"], "left_anti")
        joined = written(hot_join(alike, begins, ["leaf", "first"], "n", alike.count()).groupBy("leaf", "rank").agg(F.min("first").alias("root")), "line-joined")
        if found is None:
            found = joined
        else:
            new = written(left.join(waiting, ["leaf", "rank"], "left_anti"), "line-begins")
            late = new if late is None else late.unionByName(new)
        left = written(left.join(waiting, ["leaf", "rank"], "left_semi").join(joined, ["leaf", "rank"], "left_anti"), "line-left")
        if left.isEmpty():
            break
    if late is not None:
        found = found.unionByName(_late(forms, late).withColumnRenamed("first", "root")).groupBy("leaf", "rank").agg(F.min("root").alias("root"))
        found = written(found, "line-joined")
    return found.unionByName(found.select("leaf", F.col("root").alias("rank"), "root").distinct())


def _recurring(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, pos, leaf, form, root, first_doc of the lines whose template an earlier document (by id) has too."""
    lines = written(_lines(docs, id_col, text_col), "lines")
    forms = lines.groupBy("leaf", "form").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("long").alias("long"))
    forms = written(forms, "forms")
    every = forms.agg(F.sum("n")).first()[0] or 0
    leaves = forms.where("long").groupBy("leaf").agg(F.count(F.lit(1)).alias("n_forms"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    leaves = written(leaves.where("n_forms > 1 and lo < hi").select("leaf", "n_forms"), "open-leaves")
    several = leaves.agg(F.sum("n_forms")).first()[0] or 0
    open_forms = written(hot_join(forms.where("long").select("leaf", "form", "lo", "n"), leaves, "leaf", "n_forms", several), "open-forms")
    # A form that very many lines have is hot: its first line is looked for among all of them.
    first = hot_join(lines.where("long").select("doc_id", "pos", "leaf", "form"), open_forms, ["leaf", "form"], "n", every).where("doc_id = lo")
    wanted = first.groupBy("leaf", "form", "doc_id").agg(F.min("pos").alias("pos"))
    tokens = written(_tokens(docs, wanted, id_col, text_col), "line-tokens")
    groups = tokens.select("leaf", "form", "rank").join(_groups(tokens), ["leaf", "rank"]).select("leaf", "form", F.xxhash64("root").alias("root"))
    grouped = written(forms.join(groups, ["leaf", "form"], "left").withColumn("root", F.coalesce("root", "form")), "line-groups")
    seen = grouped.groupBy("leaf", "root").agg(F.min("lo").alias("first_doc"), F.max("hi").alias("last_doc"), F.count(F.lit(1)).alias("n_forms"))
    seen = written(seen.where("first_doc < last_doc").select("leaf", "root", "first_doc", "n_forms"), "recurring-groups")
    many = seen.agg(F.sum("n_forms")).first()[0] or 0
    again = written(hot_join(grouped.select("leaf", "form", "root", "n"), seen, ["leaf", "root"], "n_forms", many), "recurring-forms")
    found = hot_join(lines.select("doc_id", "pos", "leaf", "form"), again, ["leaf", "form"], "n", every)
    return found.where("doc_id > first_doc")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos of the lines whose template an earlier document (by id) has too.

    The tree has the token count at its first level and the first DEPTH tokens below it. Only hashes of lines
    are shuffled, except for leaves with several different lines in several documents, whose tokens are compared.
    """
    return _recurring(docs, id_col, text_col).select("doc_id", "pos")


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """template, n_lines of what recurs: the tokens of a group, with a variable field wherever its dropped lines differ."""
    found = written(_recurring(docs, id_col, text_col).select(F.col("doc_id").alias("d"), "pos", "leaf", "root"), "dropped-lines")
    texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text")).dropDuplicates(["d"])
    tokens = found.join(texts, "d").select("leaf", "root", "d", "pos", _masked(F.get(F.split("text", "\n"), F.col("pos"))).alias("tokens"))
    places = tokens.select("leaf", "root", F.posexplode("tokens").alias("at", "token"))
    fixed = places.groupBy("leaf", "root", "at").agg(F.min("token").alias("a"), F.max("token").alias("b"), F.count(F.lit(1)).alias("n"))
    made = F.struct("at", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit(_ANY)).alias("token"))
    built = fixed.groupBy("leaf", "root").agg(F.sort_array(F.collect_list(made)).alias("parts"), F.max("n").alias("n_lines"))
    return built.select(F.array_join("parts.token", " ").alias("template"), "n_lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, text.

    A line is dropped when its template recurs across documents, except in the document with the smallest id
    that has it. Lines of a leaf form groups: a group begins with the first of its lines, and the others differ from that
    in three of ten tokens at most; wherever they do, the template has a variable field. Tokens with digits are variable in
    lines of MIN_TOKENS tokens or more, shorter lines are of one template only if they are equal. So a
    dropped line may differ from the one that stays in its variable fields. Lines without a token always stay, and so
    does a line that recurs within one document only.

    A null text counts as one empty line. Rows with a null id keep all lines and don't count
    for others. Rows that repeat an id are treated
    alike; if they have different texts, positions of both apply to each. An empty table gives no rows.
    """
    drop = written(recurring_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.collect_set("pos").alias("drop")), "dropped")
    size = drop.agg(F.sum(F.size("drop") * 4 + F.lit(LINE_BYTES))).first()[0] or 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Whole texts are shuffled here if the list isn't small: ids that many rows share, or lack, are spread.
    rows = rows.join(F.broadcast(drop), "doc_id", "left") if size <= BROADCAST_BYTES else spread_left_join(rows, drop, "doc_id")
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(F.col("drop"), i))
    return rows.select(
        "doc_id",
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("text"),
    )


#: The same by SQL, where forms are told by their tokens.
ORACLE = rf"""
    WITH raw AS (
        SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
    ), cut AS (
        SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS pos FROM raw
    ), split AS (
        SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \t\r\f\x0b]+'), lambda t: t <> '') AS tokens FROM cut WHERE doc_id IS NOT NULL
    ), lines AS (
        SELECT doc_id, pos, CASE WHEN len(tokens) >= {MIN_TOKENS} THEN list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '{_ANY}' ELSE t END) ELSE tokens END AS tokens
        FROM split WHERE len(tokens) > 0
    ), forms AS (
        SELECT tokens, [len(tokens)::VARCHAR] || tokens[1:{DEPTH}] AS leaf, min((doc_id, pos)) AS first, min(doc_id) AS lo, max(doc_id) AS hi FROM lines GROUP BY tokens
    ), leaves AS (
        SELECT leaf FROM forms WHERE len(tokens) >= {MIN_TOKENS} GROUP BY leaf HAVING count(*) > 1 AND min(lo) < max(hi)
    ), opened AS (
        SELECT f.leaf, f.tokens, f.first, len(f.tokens) - {DEPTH} AS rest, len(f.tokens) * {DIFFERENT} // 10 + 1 AS parts FROM forms f JOIN leaves USING (leaf)
    ), numbered AS (
        SELECT leaf, tokens, first, rest, parts, unnest(range(parts)) AS i FROM opened
    ), segments AS (
        SELECT leaf, tokens, first, i, tokens[{DEPTH} + rest * i // parts + 1 : {DEPTH} + rest * (i + 1) // parts] AS part FROM numbered
    ), firsts AS (
        SELECT leaf, i, part, min(first) AS root FROM segments GROUP BY leaf, i, part
    ), pairs AS (
        SELECT DISTINCT s.leaf, s.tokens, s.first, f.root FROM segments s JOIN firsts f USING (leaf, i, part) WHERE f.root <> s.first
    ), alike AS (
        SELECT p.leaf, p.tokens, p.first, p.root FROM pairs p JOIN opened o ON o.leaf = p.leaf AND o.first = p.root
        WHERE 10 * len(list_filter(list_zip(p.tokens, o.tokens), lambda x: x[1] <> x[2])) <= {DIFFERENT} * len(p.tokens)
    ), grouped AS (
        SELECT a.leaf, a.tokens, min(a.root) AS root FROM alike a
        WHERE NOT EXISTS (SELECT 1 FROM alike b WHERE b.leaf = a.leaf AND b.first = a.root) GROUP BY a.leaf, a.tokens
    ), named AS (
        SELECT f.leaf, f.tokens, f.lo, f.hi, coalesce(g.root, f.first) AS root FROM forms f LEFT JOIN grouped g ON f.leaf = g.leaf AND f.tokens = g.tokens
    ), seen AS (
        SELECT leaf, root, min(lo) AS first_doc FROM named GROUP BY leaf, root HAVING min(lo) < max(hi)
    ), dropped AS (
        SELECT l.doc_id, list(DISTINCT l.pos) AS gone
        FROM lines l JOIN named n ON l.tokens = n.tokens JOIN seen s ON n.leaf = s.leaf AND n.root = s.root
        WHERE l.doc_id > s.first_doc GROUP BY l.doc_id
    )
    SELECT r.doc_id, len(r.parts)::BIGINT AS n_lines, coalesce(len(d.gone), 0)::BIGINT AS n_dropped,
           CASE WHEN d.gone IS NULL THEN coalesce(r.text, '')
                ELSE array_to_string(list_filter(r.parts, lambda x, i: NOT list_contains(d.gone, i - 1)), chr(10)) END AS text
    FROM raw r LEFT JOIN dropped d ON r.doc_id = d.doc_id
"""
