"""Blocks, pages, sections, batches and reconstructed tables from spans with geometry.

Spans are rows (doc_id, page_no, block_no, span_no, text, x0, y0, x1, y1). Every window below is
partitioned by page or document, so a task holds one page or one document's headings at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Numeric tokens, scale annotations, limits of the layout rules.
NUMERIC = r"^[+\-]?[₹$]?\(?[\d,]+(\.\d+)?\)?%?$"
SCALE_ANNOTATION = r"(?i)\(\s*[₹$]?\s*(?:in\s+)?(?:million|crore|lakh|thousand|billion|%|percent)\s*\)"
MIN_CHARS, HEADING_CHARS, SLIDE_CHARS, SLIDE_COVER = 40, 80, 1200, 0.30
ROW_GAP, COLUMN_GAP, MIN_NUMERIC = 2.0, 15.0, 3
HEADER_REACH, HEADER_OVERLAP, CAPTION_REACH, CELL_SLACK = 60.0, 0.3, 50.0, 8.0
SAMPLE_CHARS = 4000
BATCH_CHARS, BATCH_ITEMS, BLOCK_COST, CELL_COST = 3500, 20, 120, 30
PAGE = ["doc_id", "page_no"]


def is_numeric(text: Column) -> Column:
    return strip(text).rlike(NUMERIC)


def is_heading(text: Column) -> Column:
    """Not blank, short, and not ending like a sentence or a list item; null is no heading."""
    t = strip(text)
    return F.coalesce((t != "") & (F.length(t) <= HEADING_CHARS) & ~t.rlike(r"[.,;]$"), F.lit(False))


def block_text(lines: Column) -> Column:
    """ARRAY<ARRAY<STRING>> spans of lines -> text: spans run together, blank lines dropped, lines joined by a space."""
    joined = F.transform(lines, lambda spans: F.array_join(spans, ""))
    return strip(F.array_join(F.filter(joined, lambda x: strip(x) != ""), " "))


def long_blocks(blocks: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Blocks of at least ``least`` characters; null texts are dropped."""
    return blocks.filter(F.length("text") >= least)


def route_pages(blocks: DataFrame, max_pages: int | None = None) -> DataFrame:
    """(doc_id, route, ...): pages per filing and route, up to ``max_pages`` where given. Prose and table pages go to
    extraction, slides are only counted (route ``skipped``)."""
    b = blocks if max_pages is None else blocks.filter(F.col("page_no") <= max_pages)
    route = F.when(F.col("page_type").isin("prose", "table"), F.col("page_type")).otherwise("skipped").alias("route")
    return b.groupBy("doc_id", route).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("blocks"))


def opening(blocks: DataFrame, most: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, sample): the first ``most`` characters of each filing, block after block, however many pages
    they take. Blocks that begin behind that are dropped before the texts are gathered."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "block_no").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.filter("text is not null").select("doc_id", "page_no", "block_no", F.substring("text", 1, most).alias("text"))
    b = b.withColumn("_before", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))).filter(F.col("_before") < most)
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "block_no", "text")))
    return b.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n"), 1, most).alias("sample"))


def around(text: Column, pattern: str, chars: int, most: int) -> Column:
    """The first ``most`` hits of the pattern, each with ``chars`` characters on both sides. Hits are found by
    the bare pattern: what is around one may hold another."""
    hits, between = F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), 1, most), F.split(text, pattern, -1)

    def snippet(h: Column, i: Column) -> Column:
        start = F.length(F.array_join(F.slice(between, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(hits, F.lit(1), i), ""))
        first = F.greatest(start - chars, F.lit(0))
        return F.substring(text, first + 1, start + F.length(h) + chars - first)

    return F.transform(hits, snippet)


def tag_sections(blocks: DataFrame) -> DataFrame:
    """Adds ``section``: the latest heading in document order, the block itself included; none yet gives null."""
    w = Window.partitionBy("doc_id").orderBy("page_no", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(F.when(is_heading(F.col("text")), strip(F.col("text"))), ignorenulls=True).over(w))


def _folded(df: DataFrame, group: list[str], order: list[str], name: str, start: Callable[[], tuple], step: Callable[[tuple, object], tuple], value: Column) -> DataFrame:
    """Adds INT ``name``, the first of the state after each row: rows of a group are folded in order as they stream past,
    so a group is never gathered and the fold is linear in it. ``step`` gets the state and the row's ``value``."""
    v = df.withColumn("_v", value)
    keep = [*dict.fromkeys([*group, *order])]
    fields = ", ".join(f"{c} {t}" for c, t in v.select(*keep).dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = None
        state: tuple = start()
        for pdf in frames:
            out = []
            for key, x in zip(zip(*[pdf[c] for c in group]), pdf["_v"]):
                if key != at:
                    at, state = key, start()
                state = step(state, x)
                out.append(state[0])
            yield pdf[keep].assign(**{name: pd.Series(out, index=pdf.index, dtype="int32")})

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = v.select(*keep, "_v").repartition(n, *group).sortWithinPartitions(*keep).mapInPandas(run, f"{fields}, {name} int")
    return df.join(rows, keep)


def greedy_batches(items: DataFrame, group: list[str], order: list[str], cost: Column, budget: int = BATCH_CHARS, most: int = BATCH_ITEMS) -> DataFrame:
    """Adds ``batch_no`` within each group: a new batch begins where the next item would pass the budget or
    the batch is full; an item above the budget is a batch of its own. ``group`` and ``order`` together are a
    key of the items and not null."""

    def step(state: tuple, c: object) -> tuple:
        batch, total, n = state
        c = int(c)
        if n and (total + c > budget or n >= most):
            return batch + 1, c, 1
        return batch, total + c, n + 1

    return _folded(items, group, order, "batch_no", lambda: (0, 0, 0), step, F.coalesce(cost, F.lit(0)).cast("long"))


def cell_batches(cells: DataFrame, budget: int = BATCH_CHARS, most: int = BATCH_ITEMS) -> DataFrame:
    """``header_cells`` with ``batch_no`` and ``cell_index`` (the place in the batch): cells of a page in reading order."""
    cost = F.length(F.coalesce("label", F.lit(""))) + F.length(F.coalesce("header", F.lit(""))) + F.length("value") + CELL_COST
    b = greedy_batches(cells, PAGE, ["row_no", "x0"], cost, budget, most)
    return b.withColumn("cell_index", F.row_number().over(Window.partitionBy(*PAGE, "batch_no").orderBy("row_no", "x0")) - 1)


def cluster_rows(spans: DataFrame, within: list[str]) -> DataFrame:
    """Adds ``row_no``: spans in (y0, x0) order belong to a row while within ROW_GAP of the row's first span. ``within``
    and the place and number of a span are its key and not null."""

    def step(state: tuple, y: object) -> tuple:
        row, head = state
        return (row + 1, y) if head is None or abs(y - head) > ROW_GAP else state

    return _folded(spans.withColumn("span_no", F.col("span_no").cast("int")), within, ["y0", "x0", "span_no"], "row_no", lambda: (0, None), step, F.col("y0"))


def to_pixels(bbox: Column, page_width: Column, page_height: Column, width: Column, height: Column) -> Column:
    """STRUCT(x0, y0, x1, y1) in the pixels of a page drawn ``width`` x ``height``; null for a page without a size."""
    across = F.when(page_width > 0, width / page_width)
    down = F.when(page_height > 0, height / page_height)
    return F.struct((bbox["x0"] * across).alias("x0"), (bbox["y0"] * down).alias("y0"), (bbox["x1"] * across).alias("x1"), (bbox["y1"] * down).alias("y1"))


def table_rows(spans: DataFrame) -> DataFrame:
    """Per block row: whether it is a table row (three numeric spans and more, all gaps wide)."""
    within = [*PAGE, "block_no"]
    w = Window.partitionBy(*within, "row_no").orderBy("x0")
    g = cluster_rows(spans, within).filter(is_numeric(F.col("text"))).withColumn("gap", F.lead("x0").over(w) - F.col("x1"))
    return g.groupBy(*within, "row_no").agg(((F.count("*") >= MIN_NUMERIC) & F.coalesce(F.bool_and(F.col("gap") >= COLUMN_GAP), F.lit(True))).alias("is_table"))


def coverage(shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of each page under shapes (clipped to the page; overlaps count twice); 0 where the page has no area."""
    s = shapes.join(pages.select(*PAGE, "width", "height"), PAGE)
    area = F.greatest(F.lit(0.0), F.least("x1", "width") - F.greatest("x0", F.lit(0.0))) * F.greatest(F.lit(0.0), F.least("y1", "height") - F.greatest("y0", F.lit(0.0)))
    g = s.groupBy(*PAGE).agg(F.sum(area).alias("covered"))
    share = F.when(F.col("width") * F.col("height") > 0, F.coalesce("covered", F.lit(0.0)) / (F.col("width") * F.col("height"))).otherwise(0.0)
    return pages.join(g, PAGE, "left").select(*PAGE, share.alias("coverage"))


def classify_pages(pages: DataFrame, spans: DataFrame, images: DataFrame, drawings: DataFrame) -> DataFrame:
    """(doc_id, page_no, coverage, page_type): slide where little text and much picture, else table where any
    row is a table row, else prose. ``pages`` has width, height, char_count."""
    seen = coverage(images, pages).join(coverage(drawings, pages).withColumnRenamed("coverage", "drawn"), PAGE)
    tables = table_rows(spans).groupBy(*PAGE).agg(F.bool_or("is_table").alias("has_table"))
    j = pages.join(seen, PAGE).join(tables, PAGE, "left").withColumn("visual", F.greatest("coverage", "drawn"))
    kind = F.when((F.col("char_count") < SLIDE_CHARS) & (F.col("visual") > SLIDE_COVER), "slide").when(F.col("has_table"), "table").otherwise("prose")
    return j.select(*PAGE, F.col("visual").alias("coverage"), kind.alias("page_type"))


def _overlap(x0: Column, x1: Column, left: Column, right: Column) -> Column:
    """Share of [x0, x1] that lies over [left, right]; 0 for a span without width."""
    shared = F.greatest(F.lit(0.0), F.least(x1, right) - F.greatest(x0, left))
    return F.when(x1 > x0, shared / (x1 - x0)).otherwise(0.0)


def table_cells(spans: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, label, value, x0, x1, y0, y1): each numeric cell with its row's label, the
    leftmost text that is no number; rows without a number are none."""
    r = cluster_rows(spans, PAGE)
    r = r.join(r.filter(is_numeric(F.col("text"))).select(*PAGE, "row_no").distinct(), [*PAGE, "row_no"], "left_semi")
    labels = r.filter(~is_numeric(F.col("text"))).groupBy(*PAGE, "row_no").agg(F.min_by(strip(F.col("text")), "x0").alias("label"))
    cells = r.filter(is_numeric(F.col("text")))
    return cells.join(labels, [*PAGE, "row_no"], "left").select(*PAGE, "row_no", "label", strip(F.col("text")).alias("value"), "x0", "x1", "y0", "y1")


def _bounds(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*PAGE).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y0").alias("top"))


def table_headers(spans: DataFrame) -> DataFrame:
    """Header spans of each page's table with the column range [lo, hi] each stands for.

    Headers lie above the data within HEADER_REACH, over it, and read like headings but no scale
    annotation. In a header row the range reaches half-way to the neighbours and is open at the ends; a
    header alone in its row keeps its own width.
    """
    bounds = _bounds(table_cells(spans))
    h = cluster_rows(spans, PAGE).join(bounds, PAGE)
    h = h.filter(
        (F.col("y1") <= F.col("top") + 1) & (F.col("top") - F.col("y1") <= HEADER_REACH) & is_heading(F.col("text")) & ~is_numeric(F.col("text"))
        & ~F.col("text").rlike(SCALE_ANNOTATION) & (_overlap(F.col("x0"), F.col("x1"), F.col("left"), F.col("right")) > HEADER_OVERLAP)
    )
    w, row = Window.partitionBy(*PAGE, "row_no").orderBy("x0"), Window.partitionBy(*PAGE, "row_no")
    alone = F.count("*").over(row) == 1
    lo = F.when(alone, F.col("x0")).otherwise(F.coalesce((F.lag("x1").over(w) + F.col("x0")) / 2, F.lit(float("-inf"))))
    hi = F.when(alone, F.col("x1")).otherwise(F.coalesce((F.lead("x0").over(w) + F.col("x1")) / 2, F.lit(float("inf"))))
    return h.withColumns({"lo": lo, "hi": hi}).select(*PAGE, "row_no", strip(F.col("text")).alias("header"), "x0", "x1", "y0", "y1", "lo", "hi")


def header_cells(spans: DataFrame) -> DataFrame:
    """Every cell with the headers over its centre, top to bottom, joined by a space. The range join runs
    within a page (equi-join on the page, range as residual)."""
    cells, heads = table_cells(spans), table_headers(spans)
    h = heads.select(*PAGE, "header", F.col("y0").alias("hy"), "lo", "hi")
    mid = (F.col("x0") + F.col("x1")) / 2
    key = [*PAGE, "row_no", "x0"]
    m = cells.join(h, PAGE).filter((mid >= F.col("lo") - CELL_SLACK) & (mid <= F.col("hi") + CELL_SLACK))
    text = m.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hy", "header"))), lambda x: x["header"]), " ").alias("header"))
    return cells.join(text, key, "left").select(*PAGE, "row_no", "label", "value", "x0", "header")


def captions(spans: DataFrame) -> DataFrame:
    """(doc_id, page_no, caption): headings and scale annotations above the headers within CAPTION_REACH."""
    top = table_headers(spans).groupBy(*PAGE).agg(F.min("y0").alias("top"))
    bounds = _bounds(table_cells(spans)).drop("top").join(top, PAGE)
    c = spans.join(bounds, PAGE).filter(
        (F.col("y1") <= F.col("top") + 1) & (F.col("top") - F.col("y1") <= CAPTION_REACH) & (_overlap(F.col("x0"), F.col("x1"), F.col("left"), F.col("right")) > 0)
        & (is_heading(F.col("text")) | F.col("text").rlike(SCALE_ANNOTATION)) & (F.col("y0") < F.col("top"))
    )
    return c.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", strip(F.col("text")).alias("t")))), lambda x: x["t"]), " — ").alias("caption"))


def header_qualifiers(header: Column, reporting_period: Column) -> Column:
    """MAP of what a column header says: itself, a consolidation basis, a period label from a bare ``FYdd`` or
    from its year against the document's fiscal year (the same year, or the year before)."""
    basis = F.nullif(F.lower(F.regexp_extract(header, r"(?i)\b(standalone|consolidated)\b", 1)), F.lit(""))
    stripped = strip(header)
    year = F.nullif(F.regexp_extract(header, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")
    ends = F.nullif(F.regexp_extract(reporting_period, r"FY\s?(\d{2})\b", 1), F.lit("")).cast("int") + 2000
    label = (
        F.when(stripped.rlike(r"(?i)^FY\s?\d{2}$"), F.regexp_replace(F.upper(stripped), r"\s+", ""))
        .when(year == ends, reporting_period)
        .when(year == ends - 1, F.concat(F.lit("FY"), F.lpad(((ends - 1) % 100).cast("string"), 2, "0")))
    )
    keys = F.array(F.lit("column_header"), F.lit("consolidation"), F.lit("period_label"))
    return F.map_filter(F.map_from_arrays(keys, F.array(header, basis, label)), lambda k, v: v.isNotNull())


def table_number(raw: Column) -> Column:
    """A cell's number: commas dropped, brackets as minus, a trailing per cent sign dropped; else null."""
    c = F.regexp_replace(F.regexp_replace(F.translate(strip(raw), ",", ""), r"\(", "-"), r"\)", "")
    return F.regexp_replace(c, r"%$", "").try_cast("double")
