"""Page layout, label-value pairs, numeric facts and batches of pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import amounts_in, parse_grouped
from ..functions.rules import categories
from ..functions.text import lines, strip, text_of, useful_length

MAX_COLUMNS = 400
PAIRS_PER_PAGE, COLUMN_TOLERANCE, CELL_GAP = 12, 3, 2
#: Words that are no labels.
BOILERPLATE = (
    "pag", "p", "pg", "pagina", "p.", "n", "n.", "nr", "nr.", "n°", "num", "no.", "rif", "rif.", "tel", "tel.", "fax", "email",
    "e-mail", "cc", "c.c", "data", "dat", "di", "e", "il", "la", "le", "l", "del", "della", "delle", "dei", "per", "con", "su",
    "oggetto", "sede", "cod", "cod.", "numero",
)


def words_of_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, text, x0, x1, y0, y1, height) from nested blocks, paragraphs, lines and words."""
    out = pages.select("page_id", F.explode("blocks").alias("b")).select("page_id", F.explode("b.paragraphs").alias("p")).select("page_id", F.explode("p.lines").alias("l"))
    out = out.select("page_id", F.col("l.row_height").alias("height"), F.explode("l.words").alias("w"))
    return out.select("page_id", strip(F.col("w.text")).alias("text"), "w.x0", "w.x1", "w.y0", "w.y1", "height").filter("text <> ''")


def _grid(page: pd.DataFrame) -> str:
    """Words as a monospace grid: visual rows by the running mean of their middles, columns by the usual letter width."""
    width = [w for w in ((page.x1 - page.x0) / page.text.str.len()) if w > 0]
    if not width:
        return " ".join(page.text)
    letter = median(width)
    heights = [h if h == h and h > 0 else y for h, y in zip(page.height, page.y1 - page.y0, strict=True)]
    reach = max(1.0, median(heights) / 2)
    middle = (page.y0 + page.y1) / 2
    rows: list[tuple[float, list]] = []
    for m, x, text in sorted(zip(middle, page.x0, page.text, strict=True)):
        if rows and abs(m - rows[-1][0] / len(rows[-1][1])) <= reach:
            rows[-1] = (rows[-1][0] + m, [*rows[-1][1], (x, text)])
        else:
            rows.append((m, [(x, text)]))
    out = []
    for _, cells in rows:
        line = ""
        for x, text in sorted(cells):
            column = min(MAX_COLUMNS, int(x / letter + 0.5))
            line += " " * (column - len(line)) if len(line) < column else (" " if line else "")
            line += text
        out.append(line)
    return "\n".join(out)


def spatial_pages(words: DataFrame) -> DataFrame:
    """(page_id, page): a running mean is sequential, so each page's words meet in one group (a page is small)."""
    kind = words.schema["page_id"].dataType.simpleString()

    def build(page: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"page_id": page.page_id.iloc[:1], "page": [_grid(page)]})

    return words.groupBy("page_id").applyInPandas(build, f"page_id {kind}, page string")


def line_tokens(pages: DataFrame, page: str = "page") -> DataFrame:
    """(page_id, row, tokens): lines from 1, each an array of (text, x) by spaces and tabs."""
    listed = pages.select("page_id", F.posexplode(F.split(text_of(F.col(page)), "\n")).alias("row", "line"))
    parts = F.split(F.col("line"), r"[ \t]")
    step = F.aggregate(
        parts, F.expr("named_struct('x', 0, 'out', cast(array() as array<struct<text:string,x:int>>))"),
        lambda acc, w: F.struct((acc["x"] + F.length(w) + 1).alias("x"), F.when(w == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(w.alias("text"), acc["x"].alias("x"))))).alias("out")),
    )["out"]
    return listed.select("page_id", (F.col("row") + 1).alias("row"), step.alias("tokens"))


def value_like(t: Column) -> Column:
    """Dates, years, amounts, percentages, and words with a digit and at most one letter."""
    return (
        t.rlike(r"^[+-]?\d{1,2}[./-]\d{1,2}[./-]\d{2,4}$") | t.rlike(r"^[+-]?\d{4}$") | t.rlike(r"^[+-]?\d{1,3}(\.\d{3})*(,\d+)?[€¢]?$")
        | t.rlike(r"^[+-]?\d+(,\d+)?[ ]?[€%]?$") | (t.rlike(r"\d") & (F.length(F.regexp_replace(t, "[0-9.,:€%/+ -]", "")) <= 1))
    )


def _acceptable(label: Column, value: Column) -> Column:
    good_label = (F.length(label) >= 2) & ~F.lower(label).isin(*BOILERPLATE) & ~label.rlike(r"^[\d.,:/-]+$")
    return good_label & (value != "") & (F.length(value) <= 50) & (F.size(F.split(value, r"\s+")) <= 5) & value.rlike(r"\d")


def label_value_pairs(pages: DataFrame, page: str = "page") -> DataFrame:
    """(page_id, row, label, value, column): pairs by a colon on a line, then labels above values in a column.

    At most PAIRS_PER_PAGE distinct pairs a page, in order (the feature of the list).
    """
    rows = line_tokens(pages, page)
    # a colon: the words since the last value-free stretch are the label, the words up to the next colon's label the value
    words = F.transform("tokens", lambda t: t["text"])
    flat = F.aggregate(
        words, F.expr("named_struct('label', cast(null as string), 'pending', cast(array() as array<string>), 'value', cast(array() as array<string>), 'out', cast(array() as array<struct<label:string,value:string>>))"),
        lambda a, w: F.when(
            w.endswith(":"),
            F.struct(F.array_join(F.concat(a["pending"], F.array(F.regexp_replace(w, ":$", ""))), " ").alias("label"), F.array().cast("array<string>").alias("pending"), F.array().cast("array<string>").alias("value"), F.when(a["label"].isNotNull(), F.concat(a["out"], F.array(F.struct(a["label"].alias("label"), F.array_join(a["value"], " ").alias("value"))))).otherwise(a["out"]).alias("out")),
        ).when(a["label"].isNotNull(), F.struct(a["label"].alias("label"), a["pending"].alias("pending"), F.concat(a["value"], F.array(w)).alias("value"), a["out"].alias("out")))
        .otherwise(F.struct(a["label"].alias("label"), F.when(value_like(w), a["pending"]).otherwise(F.concat(a["pending"], F.array(w))).alias("pending"), a["value"].alias("value"), a["out"].alias("out"))),
        lambda a: F.when(a["label"].isNotNull(), F.concat(a["out"], F.array(F.struct(a["label"].alias("label"), F.array_join(a["value"], " ").alias("value"))))).otherwise(a["out"]),
    )
    colon = rows.select("page_id", "row", F.posexplode(flat).alias("nth", "p")).select(
        "page_id", F.lit(0).alias("pass"), "row", "nth", F.trim(F.regexp_replace("p.label", ":+$", "")).alias("label"), F.trim("p.value").alias("value"), F.lit(None).cast("int").alias("column")
    )
    # columns: cells of a line without values, and the nearest value of the next line
    has_value = F.exists("tokens", lambda t: value_like(t["text"]))
    cells = F.aggregate(
        "tokens", F.expr("cast(array() as array<struct<x:int,end:int,text:string>>)"),
        lambda a, t: F.when(
            (F.size(a) > 0) & (t["x"] - F.get(a, F.size(a) - 1)["end"] < CELL_GAP),
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["x"].alias("x"), (t["x"] + F.length(t["text"])).alias("end"), F.concat(F.get(a, F.size(a) - 1)["text"], F.lit(" "), t["text"]).alias("text")))),
        ).otherwise(F.concat(a, F.array(F.struct(t["x"].alias("x"), (t["x"] + F.length(t["text"])).alias("end"), t["text"].alias("text"))))),
    )
    follow = rows.withColumn("next", F.lead("tokens").over(Window.partitionBy("page_id").orderBy("row")))
    heads = follow.filter((F.size("tokens") > 0) & ~has_value).filter(F.exists("next", lambda t: value_like(t["text"])))
    heads = heads.select("page_id", "row", "next", F.posexplode(cells).alias("nth", "c"))
    near = F.array_min(F.transform(F.filter("next", lambda t: value_like(t["text"]) & (F.abs(t["x"] - F.col("c.x")) <= COLUMN_TOLERANCE)), lambda t: F.struct(F.abs(t["x"] - F.col("c.x")).alias("d"), t["x"].alias("x"), t["text"].alias("text"))))
    below = heads.select("page_id", F.lit(1).alias("pass"), "row", "nth", F.trim("c.text").alias("label"), near["text"].alias("value"), F.col("c.x").alias("column")).filter("value IS NOT NULL")
    every = colon.unionByName(below).filter(_acceptable(F.col("label"), F.col("value")))
    once = every.groupBy("page_id", "row", "label", "value").agg(F.min(F.struct("pass", "nth", "column")).alias("m")).select("page_id", "row", "label", "value", "m.pass", "m.nth", "m.column")
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("page_id").orderBy("pass", "row", "nth")))
    return ranked.filter(F.col("r") <= PAIRS_PER_PAGE).select("page_id", "row", "label", "value", "column")


def with_pairs(page: Column, pairs: Column) -> Column:
    """A page with its pairs, (label, value) structs, listed before it."""
    listed = F.array_join(F.transform(pairs, lambda p: F.concat(p["label"], F.lit(": "), p["value"])), "\n")
    return F.when(F.size(pairs) > 0, F.concat(listed, F.lit("\n"), page)).otherwise(page)


def numeric_facts(pages: DataFrame, vocabulary: Mapping[str, Sequence[str]], text: str = "text", least: float = 50.0) -> DataFrame:
    """(page_id, row, value, cats, value_key): amounts of lines with the categories that the line's words name.

    The key is the rounded value as a double, as runs of digits may pass any integer; those past a double are no amounts.
    """
    rows = pages.select("page_id", F.posexplode(lines(F.col(text))).alias("row", "line"))
    found = rows.select("page_id", "row", F.explode(amounts_in(F.col("line"))).alias("value"), categories(F.lower("line"), vocabulary).alias("cats"))
    return found.filter((F.col("value") > least) & (F.col("value") < float("inf"))).withColumn("value_key", F.round("value"))


def facts_index(facts: DataFrame) -> DataFrame:
    """(value_key, pages, facts): where each rounded value occurs."""
    return facts.groupBy("value_key").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("facts"))


def hints(pages: DataFrame, rules: Sequence[tuple[str, str, str, float, str]], text: str = "text") -> DataFrame:
    """(page_id, row, kind, raw, value, confidence, pattern): what rules (kind, regex, deny regex, confidence, name) find.

    A rule's first group is the value; a line that the deny expression matches gives none.
    """
    rows = pages.select("page_id", F.posexplode(lines(F.col(text))).alias("row", "line"))
    out = []
    for kind, regex, deny, confidence, name in rules:
        hit = F.when(~F.col("line").rlike(deny), F.regexp_extract_all("line", F.lit(regex), 1)) if deny else F.regexp_extract_all("line", F.lit(regex), 1)
        out.append(F.transform(F.coalesce(hit, F.array().cast("array<string>")), lambda raw, k=kind, c=confidence, n=name: F.struct(F.lit(k).alias("kind"), raw.alias("raw"), parse_grouped(raw).alias("value"), F.lit(c).alias("confidence"), F.lit(n).alias("pattern"))))
    return rows.select("page_id", "row", F.explode(F.flatten(F.array(*out))).alias("h")).select("page_id", "row", "h.*")


def look_ahead(rows: DataFrame, header: Column, group: Sequence[str], order: str, reach: int, wanted: Column) -> DataFrame:
    """Each header line with the first of the next ``reach`` lines that fits; lines as wide structs in ``hit``."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(1, reach)
    hit = F.first(F.when(wanted, F.struct(*[F.col(c) for c in rows.columns])), ignorenulls=True).over(w)
    return rows.withColumn("_header", header).withColumn("hit", hit).filter("_header AND hit IS NOT NULL").drop("_header")


def page_batches(pages: DataFrame, group: str, order: Sequence[str], text: str, budget: int) -> DataFrame:
    """(group, batch, text): pages in order, next-fit by useful length; a page over the budget is cut to it.

    Next-fit is sequential within a group (a dossier), so a group is one Pandas call; groups are independent.
    """
    cut = F.when(useful_length(F.col(text)) > budget, F.left(F.col(text), F.lit(budget))).otherwise(F.col(text))
    rows = pages.filter(F.trim(text_of(F.col(text))) != "").select(F.col(group).alias("g"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], cut.alias("t"), useful_length(cut).alias("cost"))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([c for c in part.columns if c.startswith("o")], kind="stable")
        batches: list[list[str]] = [[]]
        used = 0
        for t, cost in zip(part.t, part.cost, strict=True):
            if batches[-1] and used + cost + 2 > budget:
                batches.append([])
                used = 0
            batches[-1].append(t)
            used += cost + 2
        return pd.DataFrame({"g": part.g.iloc[0], "batch": range(len(batches)), "text": ["\n\n".join(b) for b in batches]})

    kind = rows.schema["g"].dataType.simpleString()
    return rows.groupBy("g").applyInPandas(fill, f"g {kind}, batch int, text string").withColumnRenamed("g", group)


def estimated_tokens(text: Column, per_token: float = 3.5) -> Column:
    return F.ceil(F.length(text) / F.lit(per_token)).cast("long")


def safe_context_budget(limit: int, prompt_tokens: int, answer_tokens: int, margin: float = 0.7) -> int:
    """Characters that a prompt may hold: the smaller of a share of the limit and what prompt and answer leave, twice."""
    return max(0, int(min(margin * limit, limit - prompt_tokens - answer_tokens) * 2))
