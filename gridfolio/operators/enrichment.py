"""Document types, table metadata, and reconciliation of two extractions of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfolio.functions import dates, nested, numeric
from gridfolio.functions.text import any_of

#: Words that point to each type of document.
TYPE_WORDS = {
    "financial": ["revenue", "profit", "loss", "balance sheet", "income", "expense", "cash flow", "quarterly", "annual report", "fiscal", "ebitda", "invoice", "budget", "financial", "p&l", "dividend", "shares", "operating profit"],
    "legal": ["agreement", "contract", "clause", "whereas", "party", "parties", "indemnif", "liability", "termination", "governing law", "nda", "confidential", "breach", "obligation", "arbitration", "jurisdiction", "warranty"],
    "entity": ["organization chart", "org chart", "subsidiary", "hierarchy", "relationship", "entity", "parent company", "division", "board of directors", "affiliates"],
    "policy": ["policy", "procedure", "sop", "guideline", "standard", "manual", "process", "faq", "regulation", "compliance", "rule", "code of conduct"],
}
#: Currency signs and codes.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}
#: Words of a caption or header that make a table's category, in order of precedence.
CATEGORY_WORDS = {
    "balance_sheet": ["balance sheet", "assets", "liabilities", "shareholders equity", "stockholders equity", "shareholders' equity"],
    "income_statement": ["income statement", "revenue", "profit", "income", "expenses", "p&l", "profit and loss", "profit & loss"],
    "cash_flow": ["cash flow", "cashflow"],
    "kpi": ["ratio", "margin", "kpi", "key performance indicator"],
    "comparison": [" vs ", " vs. ", "budget", "actual", "variance", "comparison"],
}
#: Units of a table, the more specific first.
UNITS = ["usd millions", "usd billions", "usd thousands", "in millions", "in billions", "in thousands", "millions", "billions", "thousands", "per share", "%"]
#: Shares of a second extraction's numbers that the reference need not have: a grid with merged cells, and no reliable grid.
MERGED_TOLERANCE, LOOSE_TOLERANCE = 0.08, 0.20


def type_scores(text: Column, n_tables: Column) -> Column:
    """Struct of the number of words of each type in a text; two tables or more add 2 to financial."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda words: reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])
    more = F.when(n_tables >= 2, 2).otherwise(0)
    return F.struct(*[(count(words) + (more if t == "financial" else 0)).alias(t) for t, words in TYPE_WORDS.items()])


def document_types(df: DataFrame, text_col: str, n_tables: Column | None = None, filename: Column | None = None) -> DataFrame:
    """Adds document_types (array) and type_confidence: types with at least half of the best score and 2, else the best, else policy.

    Words of the file's name count as those of the text.
    """
    text = F.col(text_col) if filename is None else F.concat_ws(" ", filename, F.col(text_col))
    scored = df.withColumn("__s", type_scores(text, F.lit(0) if n_tables is None else n_tables))
    best = F.greatest(*[F.col(f"__s.{t}") for t in TYPE_WORDS])
    limit = F.greatest(F.lit(2), F.floor(best * 0.5).cast("int"))
    pairs = F.array(*[F.struct(F.lit(t).alias("type"), F.col(f"__s.{t}").alias("score")) for t in TYPE_WORDS])
    over = F.transform(F.filter(pairs, lambda p: p["score"] >= limit), lambda p: p["type"])
    first = F.slice(F.transform(F.filter(pairs, lambda p: p["score"] == best), lambda p: p["type"]), 1, 1)
    types = F.when(best == 0, F.array(F.lit("policy"))).when(F.size(over) > 0, over).otherwise(first)
    return scored.withColumns({"document_types": types, "type_confidence": F.least(F.lit(0.9), 0.4 + 0.05 * best)}).drop("__s")


def currency(text: Column) -> Column:
    """Of the first currency sign in a text, else of the first code that is a word of its own."""
    sign = F.regexp_extract(text, "[$€£₹]", 0)
    code = F.regexp_extract(text, rf"\b({'|'.join(CURRENCY_SIGNS.values())})\b", 1)
    named = F.lit(None).cast("string")
    for s, c in CURRENCY_SIGNS.items():
        named = F.when(sign == s, F.lit(c)).otherwise(named)
    return F.coalesce(named, F.when(code != "", code))


def table_category(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit("other")
    for name, words in reversed(CATEGORY_WORDS.items()):
        out = F.when(any_of(low, words), F.lit(name)).otherwise(out)
    return out


def units(text: Column) -> Column:
    """The units that a text names, the more specific first; null without one."""
    low = F.lower(text)
    found = F.filter(F.array(*[F.lit(u) for u in UNITS]), lambda u: F.contains(low, u))
    return F.when(F.size(found) > 0, found)


def enriched_tables(df: DataFrame, given: str | None = None) -> DataFrame:
    """Adds currency, fiscal_year, reporting_period, table_category, units and table_summary to (caption, headers, rows).

    Values of a struct column ``given`` (from an injected reader of the table's image) win where they aren't blank;
    a category outside the known ones is ignored.
    """
    title = F.concat_ws(" ", F.coalesce("caption", F.lit("")), F.array_join(F.coalesce("headers", F.array()), " "))
    corpus = F.concat_ws(" ", title, F.array_join(F.flatten(F.coalesce("rows", F.array().cast("array<array<string>>"))), " "))
    said = lambda name: F.when(F.trim(F.col(f"{given}.{name}")) != "", F.col(f"{given}.{name}")) if given else F.lit(None).cast("string")
    known = F.when(said("table_category").isin(*CATEGORY_WORDS, "other"), said("table_category"))
    n_rows, n_columns = F.size(F.coalesce("rows", F.array().cast("array<array<string>>"))), F.size(F.coalesce("headers", F.array()))
    listed = F.when(n_columns > 0, F.concat(F.lit(" Columns: "), F.array_join(F.slice("headers", 1, 12), ", "))).otherwise("")
    summary = F.concat(F.coalesce(F.when(F.col("caption") != "", F.col("caption")), F.lit("Table")), F.lit(" — "), n_rows.cast("string"), F.lit(" rows × "), n_columns.cast("string"), F.lit(" columns."), listed)
    return df.withColumns(
        {
            "currency": F.coalesce(said("currency"), currency(corpus)),
            "fiscal_year": F.coalesce(said("fiscal_year"), dates.fiscal_year(corpus)),
            "reporting_period": F.coalesce(said("reporting_period"), dates.reporting_period(corpus)),
            "table_category": F.coalesce(known, table_category(title)),
            "units": units(corpus),
            "table_summary": summary,
        }
    )


def faithful(candidate_rows: Column, reference_text: Column, reference_rows: Column, merged_cells: Column) -> Column:
    """Whether the numbers of a second extraction can be traced to the reference.

    None may be new where the reference grid is uniform without merged cells, 8 % with them, 20 % without a grid.
    """
    mine = nested_numbers(candidate_rows)
    seen = F.array_union(nested_numbers(reference_rows), numeric.numeric_tokens(reference_text))
    unseen = F.size(F.array_except(mine, seen)) / F.greatest(F.size(mine), F.lit(1))
    uniform = F.coalesce(nested.uniform_width(reference_rows), F.lit(False))
    limit = F.when(uniform & ~F.coalesce(merged_cells, F.lit(False)), 0.0).when(uniform, MERGED_TOLERANCE).otherwise(LOOSE_TOLERANCE)
    return (F.size(mine) == 0) | (unseen <= limit)


def nested_numbers(rows: Column) -> Column:
    return numeric.grid_numbers(F.coalesce(rows, F.array().cast("array<array<string>>")))


def reconciled(df: DataFrame) -> DataFrame:
    """Chooses between grid_headers/grid_rows and a second reading image_headers/image_rows: adds method, quality, headers, rows.

    Without a second reading, or with one that isn't faithful, or beside a well-formed grid, the grid stays.
    """
    grid_ok = F.coalesce(nested.well_formed(F.col("grid_headers"), F.col("grid_rows")), F.lit(False))
    image_ok = F.coalesce(nested.well_formed(F.col("image_headers"), F.col("image_rows")), F.lit(False))
    absent = F.col("image_rows").isNull()
    passed = absent | faithful(F.col("image_rows"), F.col("ocr_text"), F.col("grid_rows"), F.col("merged_cells"))
    use_image = ~absent & passed & ~grid_ok
    has_rows = F.coalesce(F.size("grid_rows") > 0, F.lit(False))
    quality = (
        F.when(absent, F.when(grid_ok, "high").when(has_rows, "medium").otherwise("low"))
        .when(~passed, "low")
        .when(use_image, F.when(image_ok, "high").otherwise("medium"))
        .otherwise("high")
    )
    return df.withColumns(
        {
            "method": F.when(use_image, "image_vlm").otherwise("pdf_grid"),
            "quality": quality,
            "headers": F.when(use_image, F.col("image_headers")).otherwise(F.col("grid_headers")),
            "rows": F.when(use_image, F.col("image_rows")).otherwise(F.col("grid_rows")),
        }
    )
