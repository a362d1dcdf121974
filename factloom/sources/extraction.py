"""Proposals from a provider's responses to facts, and spans of documents as files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import canonical_entity, canonical_measure
from ..functions.text import slug
from ..operators.layout import MIN_CHARS, block_text, classify_pages, header_qualifiers, long_blocks, table_number
from ..providers import in_halves
from .cache import doc_id_of

PROPOSAL = T.StructType(
    [T.StructField("block_index", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("subject_surface_form", "subject_type", "measure_surface_form", "fact_type", "value_raw")]
    + [T.StructField("value_number", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("value_unit", "value_currency", "value_scale", "value_direction")]
    + [
        T.StructField("qualifiers", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("evidence_quote", T.StringType()),
    ]
)


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """``responses`` with ``facts``, an array of proposals, and ``valid``: one bad item (a missing wording or
    quote, a confidence outside 0..1) rejects the whole response, which then has no proposals."""
    parsed = F.from_json(F.col(text), T.ArrayType(PROPOSAL), {"mode": "PERMISSIVE"})
    good = lambda p: (
        p["block_index"].isNotNull() & p["subject_surface_form"].isNotNull() & p["measure_surface_form"].isNotNull() & p["value_raw"].isNotNull()
        & p["evidence_quote"].isNotNull() & p["confidence"].between(0, 1)
    )
    r = responses.withColumn("_p", parsed)
    ok = F.coalesce(F.forall("_p", lambda p: F.coalesce(good(p), F.lit(False))), F.lit(False))
    return r.withColumns({"valid": ok, "facts": F.when(ok, F.col("_p")).otherwise(F.array().cast(T.ArrayType(PROPOSAL)))}).drop("_p")


def to_facts(proposals: DataFrame, batch_size: Column) -> DataFrame:
    """Proposals (doc_id, page_no, block_no and the fields of PROPOSAL) as fact rows: blank subjects and indexes
    outside the batch are dropped; repeated qualifier keys keep their last value, and ``period_resolved`` is
    ``false`` only where it says so."""
    p = proposals.filter((F.trim("subject_surface_form") != "") & F.col("block_index").between(0, batch_size - 1))
    return p.withColumns(
        {
            "block_id": F.concat("doc_id", F.lit(":p"), F.col("page_no").cast("string"), F.lit(":b"), F.col("block_no").cast("string")),
            "subject_canonical_id": canonical_entity(F.col("subject_surface_form")),
            "measure_canonical_id": canonical_measure(F.col("measure_surface_form")),
            "qualifiers": F.transform_values(_last_of_key("qualifiers"), lambda k, v: F.when(k == "period_resolved", (F.lower(F.trim(v)) != "false").cast("string")).otherwise(v)),
        }
    )


TABLE_PROPOSAL = T.StructType(
    [T.StructField("cell_index", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("subject_surface_form", "subject_type", "measure_surface_form", "fact_type")]
    + [PROPOSAL["qualifiers"], PROPOSAL["confidence"]]
)


def _last_of_key(pairs: str) -> Column:
    return F.aggregate(
        F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")),
        F.create_map().cast("map<string,string>"),
        lambda m, q: F.map_concat(F.map_filter(m, lambda k, v: k != q["key"]), F.map_from_arrays(F.array(q["key"]), F.array(q["value"]))),
    )


def to_table_facts(semantics: DataFrame, cells: DataFrame, contexts: DataFrame) -> DataFrame:
    """Facts of table cells from what a provider says of them: ``semantics`` (doc_id, page_no, batch_no and the fields of
    TABLE_PROPOSAL) meets ``cells`` (doc_id, page_no, batch_no, cell_index, block_no, value, header, bbox) and the
    documents' contexts (doc_id, reporting_period, currency, scale).

    Value and number are the cell's own; what its header says deterministically wins over the provider's
    qualifiers; currency and scale are the document's, the unit is per cent where the text ends so. Blank
    subjects and indexes without a cell are dropped; a document without a context has no currency or scale.
    The quote is the cell's text, yet to be grounded."""
    on = ["doc_id", "page_no", "batch_no", "cell_index"]
    said = semantics.filter(F.trim("subject_surface_form") != "")
    j = said.join(cells, on).join(contexts.select("doc_id", "reporting_period", F.col("currency").alias("value_currency"), F.col("scale").alias("value_scale")).dropDuplicates(["doc_id"]), "doc_id", "left")
    own = header_qualifiers(F.col("header"), F.col("reporting_period"))
    return j.withColumns({"_own": own, "_said": _last_of_key("qualifiers")}).select(
        "doc_id",
        F.concat("doc_id", F.lit(":p"), F.col("page_no").cast("string"), F.lit(":b"), F.col("block_no").cast("string")).alias("block_id"),
        slug(F.col("subject_surface_form")).alias("subject_canonical_id"), "subject_surface_form", "subject_type",
        slug(F.col("measure_surface_form")).alias("measure_canonical_id"), "measure_surface_form", "fact_type",
        F.col("value").alias("value_raw"), table_number(F.col("value")).alias("value_number"),
        F.when(F.trim("value").endswith("%"), "%").alias("value_unit"), "value_currency", "value_scale",
        F.map_concat(F.map_filter("_said", lambda k, v: ~F.array_contains(F.map_keys("_own"), k)), "_own").alias("qualifiers"),
        F.struct(
            F.col("page_no"), F.lit(0).alias("char_start"), F.length("value").alias("char_end"), F.array("bbox").alias("bbox"), F.col("value").alias("quote"),
            F.array().cast("array<string>").alias("section_path"), F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("table_ref"),
        ).alias("evidence"),
        F.col("confidence").alias("confidence_extraction"),
    )


CONTEXT = T.StructType([T.StructField(n, T.StringType()) for n in ("publisher", "document_type", "publication_date", "reporting_period", "currency", "scale", "consolidation", "geography")])


def context_prompt(sample: Column, hints: Column) -> Column:
    """The request for a document's context: its opening, and its scale mentions from further on."""
    ask = "State what this document is, as JSON with the fields " + ", ".join(CONTEXT.names) + ". Leave a field null where the text does not say; use the mentions only for currency, scale and consolidation."
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Opening:\n"), F.coalesce(sample, F.lit(""))), F.when(F.size(hints) > 0, F.concat(F.lit("Mentions:\n"), F.array_join(hints, "\n"))))


def document_contexts(answers: DataFrame) -> DataFrame:
    """(doc_id, context MAP) of ``answers(doc_id, answer)``: the stated fields and the document's id; an answer that is no
    JSON object gives the id alone."""
    c = F.from_json("answer", CONTEXT, {"mode": "PERMISSIVE"})
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in [*CONTEXT.names, "doc_id"]]), F.array(*[F.col(f"_c.{n}") for n in CONTEXT.names], F.col("doc_id")))
    return answers.withColumn("_c", c).select("doc_id", F.map_filter(fields, lambda k, v: v.isNotNull()).alias("context"))


def batch_prompt(context: Column, items: Column, schema: T.StructType = PROPOSAL) -> Column:
    """The request for the facts of a batch: the document's context and the numbered texts (array of strings)."""
    ask = "List every fact that these numbered texts state, as a JSON array of objects with the fields " + ", ".join(schema.names) + ". Quote word for word; state nothing the texts do not."
    numbered = F.transform(items, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(x, F.lit(""))))
    return F.concat_ws("\n\n", F.lit(ask), F.concat(F.lit("Document: "), F.to_json(context)), F.array_join(numbered, "\n"))


_PARTS = "doc_id string, batch_no int, first int, items int, response string, model string, error string"


def propose(batches: DataFrame, ask: Callable[[list[str]], tuple[str, str]], workers: int = 4) -> DataFrame:
    """(doc_id, batch_no, first, items, response, model, error) of ``batches(doc_id, batch_no, items ARRAY<STRING>)``: the
    answer to each batch, or to the halves of one that was too large (``first`` is a part's first item). ``ask`` gives
    (answer, model) for a list of items or raises as in ``providers``; a failed part has an error and no response."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for d, b, items in zip(pdf["doc_id"], pdf["batch_no"], pdf["items"]):
                texts = list(items) if items is not None else []
                done, failed = in_halves(list(range(len(texts))), lambda part, texts=texts: ask([texts[i] for i in part]))
                rows += [(d, b, part[0], len(part), answer, model, None) for part, (answer, model) in done]
                rows += [(d, b, part[0], len(part), None, None, error) for part, error in failed]
            yield pd.DataFrame(rows, columns=["doc_id", "batch_no", "first", "items", "response", "model", "error"])

    return batches.select("doc_id", F.col("batch_no").cast("int"), "items").repartition(workers).mapInPandas(run, _PARTS)


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the PDF files of a folder, any case of the extension; decoding is a provider's."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.lower("path").endswith(".pdf")).select("path", "content")


_PAGE = (
    "path string, page_no int, width double, height double, char_count int, "
    "spans array<struct<block_no:int,line_no:int,span_no:int,text:string,x0:double,y0:double,x1:double,y1:double>>, "
    "images array<struct<x0:double,y0:double,x1:double,y1:double>>, drawings array<struct<x0:double,y0:double,x1:double,y1:double>>"
)
#: A file's bytes -> its pages, each with the fields of ``decode_pages`` but the path.
Decoder = Callable[[bytes], Iterable[dict]]


def decode_pages(files: DataFrame, decoder: Decoder) -> DataFrame:
    """(doc_id, page_no, width, height, char_count, spans, images, drawings) of ``files(path, content)``, a file at a time in
    the tasks. Pages are numbered from 1. The decoder is the caller's; none is bundled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page_no", "width", "height", "char_count", "spans", "images", "drawings"]
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"]):
                for page in decoder(bytes(content)):
                    yield pd.DataFrame([[path, *[page.get(n) for n in names[1:]]]], columns=names)

    return files.select("path", "content").mapInPandas(run, _PAGE).select(doc_id_of(F.col("path")).alias("doc_id"), "*").drop("path")


def page_blocks(pages: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, page_no, block_no, text, bbox, page_type): blocks of decoded pages. Spans of a line run together, lines are
    joined by a space; shorter blocks than ``least`` are dropped, but numbers count all blocks."""
    key = ["doc_id", "page_no"]
    shapes = lambda c: pages.select(*key, F.inline(c))
    spans = shapes("spans")
    kinds = classify_pages(pages.select(*key, "width", "height", "char_count"), spans, shapes("images"), shapes("drawings"))
    line = spans.groupBy(*key, "block_no", "line_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"]).alias("spans"), *[f("%s" % c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    )
    block = line.groupBy(*key, "block_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "spans"))), lambda x: x["spans"]).alias("lines"), *[f("%s" % c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    )
    b = block.select(*key, "block_no", block_text(F.col("lines")).alias("text"), F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    return long_blocks(b, least).join(kinds.select(*key, "page_type"), key)
