import pytest
from pyspark.sql import functions as F

from factloom.adjudicate import cached, narrate
from factloom.operators.ledger import Ledger
from factloom.operators.link import candidates_for_facts
from factloom.schema import FACTS
from factloom.sources.extraction import parse_responses, to_facts
from factloom.functions.keys import with_keys
from factloom.streaming.ingest import ingest_batch, ingest_stream, new_pairs
from factloom.streaming.intervals import stream_gaps


def facts(spark, rows):
    base = spark.createDataFrame(rows, "id string, doc_id string, subject_surface_form string, measure_surface_form string, fact_type string, value_raw string, qualifiers map<string,string>")
    return base.select(*[F.col(f.name).cast(f.dataType) if f.name in base.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in FACTS])


def row(i, raw, doc="d1"):
    return (i, doc, "Delhivery Limited", "Revenue", "numeric", raw, {"period_label": "FY24"})


def test_incremental_ingest(spark, tmp_path):
    led, src = Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "in")
    facts(spark, [row("a", "5"), row("b", "5"), row("a", "5")]).write.parquet(src)
    stages = []
    ingest_stream(spark, src, led, str(tmp_path / "cp"), lambda stage, data: stages.append((stage, data))).awaitTermination()
    assert [x for x, _ in stages] == ["started", "candidates_found", "facts_persisted", "done"] and stages[-1][1] == {"batch": 0, "facts": 2, "relations_by_type": {"CORROBORATES": 1}}
    assert led.read("facts").count() == 2 and led.read("relations").count() == 1
    facts(spark, [row("c", "7", "d2")]).write.mode("append").parquet(src)
    ingest_stream(spark, src, led, str(tmp_path / "cp")).awaitTermination()
    assert led.read("facts").count() == 3
    kinds = {(r.fact_a_id, r.fact_b_id): r.type for r in led.read("relations").collect()}
    assert kinds == {("a", "b"): "CORROBORATES", ("a", "c"): "CONTRADICTS", ("b", "c"): "CONTRADICTS"}
    ingest_batch(led, facts(spark, [row("c", "7", "d2")]), 7, lambda stage, data: stages.append((stage, data)))
    assert stages[-1] == ("already_ingested", {"batch": 7})
    assert led.read("facts").count() == 3 and led.read("relations").count() == 3


def test_new_pairs_take_peers_after_exclusion(spark):
    rows = [row(f"a{i:02}", "5") for i in range(9)] + [(f"b{i:02}", *row("", "5")[1:6], {"period_label": "FY23"}) for i in range(6)]
    f = with_keys(facts(spark, rows)).cache()
    key = {r.id: r.claim_key for r in f.collect()}
    assert len(set(key.values())) == 2 and f.select("loose_key").distinct().count() == 1
    want = {}
    for i in key:
        exact = [j for j in sorted(key) if j != i and key[j] == key[i]][:3]
        loose = [j for j in sorted(key) if j != i and j not in exact][:3]
        for level, js in (("exact", exact), ("loose", loose)):
            for j in js:
                pair = (min(i, j), max(i, j))
                want[pair] = min(level, want.get(pair, level))
    got = {(r.a.id, r.b.id): r.match_level for r in new_pairs(f, f, 3).collect()}
    assert got == want


def test_a_batch_that_broke_off_is_made_up_for(spark, tmp_path, monkeypatch):
    batch = facts(spark, [row(f"{i}", "5") for i in range(5)])
    for broken in ("relations", "keys", "facts"):
        led, append = Ledger(spark, str(tmp_path / broken)), Ledger.append

        def fail(self, name, rows, order=None, broken=broken, append=append):
            if name == broken:
                raise OSError("lost")
            append(self, name, rows, order)

        monkeypatch.setattr(Ledger, "append", fail)
        with pytest.raises(OSError):
            ingest_batch(led, batch)
        monkeypatch.setattr(Ledger, "append", append)
        for _ in range(2):
            ingest_batch(led, batch)
            assert led.read("facts").count() == led.read("keys").count() == 5 and led.read("relations").count() == 10
    assert led.get("facts", "3").count() == led.get("relations", led.read("relations").first().id).count() == 1
    assert led.of_document("facts", "d1").count() == 5 and led.get("facts", "none").count() == 0 and led.get("documents", "d1") is None


def test_loose_peers_behind_a_full_claim_key(spark, tmp_path):
    """150 facts of one claim key and 10 of another on the same loose key, the last of the 150 new."""
    f = with_keys(facts(spark, [row(f"{i:03}", "5") for i in range(150)] + [(f"z{i}", *row("", "5")[1:6], {"period_label": "FY23"}) for i in range(10)])).cache()
    new = f.filter("id = '149'")
    levels = [r.match_level for r in new_pairs(new, f).collect()]
    assert levels.count("exact") == 50 and levels.count("loose") == 50
    led = Ledger(spark, str(tmp_path))
    led.append("facts", f.filter("id <> '149'").select(*[c.name for c in FACTS]))
    ingest_batch(led, new.select(*[c.name for c in FACTS]))
    assert led.read("relations").count() == 100 and led.read("keys").count() == led.read("facts").count() == 160
    for leaky, loose in ((True, 50), (False, 10)):
        got = candidates_for_facts(f.select("id", "doc_id", "claim_key", "loose_key"), ["doc_id", "id"], ["doc_id"], leaky_truncation=leaky).filter("id = '000'")
        assert {r.match_level: r["count"] for r in got.groupBy("match_level").count().collect()} == {"exact": 50, "loose": loose}


def test_stream_gaps(spark, tmp_path):
    schema = "k string, s date, e date"
    src = str(tmp_path / "in")
    for n, rows in enumerate([[("a", "2020-01-01", "2020-02-01"), ("a", "2020-03-01", "2020-04-01")], [("a", "2020-02-01", "2020-02-10")]]):
        spark.createDataFrame(rows, "k string, s string, e string").select("k", F.to_date("s").alias("s"), F.to_date("e").alias("e")).coalesce(1).write.mode("append").parquet(src)
        q = stream_gaps(spark.readStream.schema(schema).parquet(src), "k", "s", "e").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        out = []
        q.foreachBatch(lambda df, i: out.extend(df.collect())).start().awaitTermination()
        last = out[-1]
    assert last.periods == 2 and last.gap_ends[0] - last.gap_starts[0] == 20


def test_provider_failures_and_cache(spark):
    def provider(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return prompt.upper()

    req = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "kept")], "key string, prompt string")
    cache = spark.createDataFrame([("3", "from cache")], "key string, answer string")
    got = {r.key: (r.answer, r.error) for r in cached(req, cache, provider).collect()}
    assert got == {"1": ("GOOD", None), "2": (None, "down"), "3": ("from cache", None)}
    rel = spark.createDataFrame([("b", "a", "SUPERSEDES", "bad one"), ("a", "c", "CONTRADICTS", "fine")], "fact_a_id string, fact_b_id string, type string, p string")
    out = {r.fact_b_id: r for r in narrate(rel, cache.limit(0), provider, F.col("p")).collect()}
    assert out["a"].explanation_pending and out["a"].type == "SUPERSEDES" and out["c"].explanation == "FINE"


def test_one_bad_item_rejects_the_response(spark):
    item = '{"block_index":%d,"subject_surface_form":"%s","measure_surface_form":"m","value_raw":"1","confidence":%s,"evidence_quote":"q","qualifiers":[{"key":"a","value":"1"},{"key":"a","value":"2"},{"key":"period_resolved","value":"No"}]}'
    rows = [("ok", f"[{item % (0, 'S', 0.5)},{item % (9, 'S', 0.5)},{item % (0, ' ', 0.5)}]"), ("bad", f"[{item % (0, 'S', 0.5)},{item % (0, 'S', 1.5)}]"), ("junk", "no json")]
    r = parse_responses(spark.createDataFrame(rows, "doc_id string, response string"))
    assert {x.doc_id: x.valid for x in r.collect()} == {"ok": True, "bad": False, "junk": False}
    p = r.select("doc_id", F.lit(1).alias("page_no"), F.lit(2).alias("block_no"), F.inline("facts"))
    f = to_facts(p, F.lit(3)).collect()
    assert len(f) == 1 and f[0].qualifiers == {"a": "2", "period_resolved": "true"} and f[0].block_id == "ok:p1:b2" and f[0].subject_canonical_id == "s"
