import io
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veilwright.operators import audit, evaluate, orphans, policy
from veilwright.sources import extract, store
from veilwright.streaming import masking as streams

T = lambda d: datetime(2026, 1, d)
U = lambda n: f"00000000-0000-0000-0000-{n:012d}"


@pytest.mark.parametrize("text,ok", [(U(1), True), (f" {{{U(1)}}}\n", True), (f"urn:uuid:{U(1)}", True), (U(1).replace("-", "").upper(), True), (U(0), False), (U(1)[:-1], False), ("n/a", False), (None, False), ("", False)])
def test_uuid(spark, text, ok):
    got = spark.createDataFrame([(text,)], "c string").select(orphans.uuid_key("c").alias("k")).first()["k"]
    assert (got is not None and int.from_bytes(got) == 1) is ok


REF = "job_id string, at timestamp, id string, key string"


def refs(spark, rows):
    return orphans.references(spark.createDataFrame([(j, t, i, "clash") for j, t, i in rows], REF), "t", "id", "job_id", "at")


def kinds(tracker):
    return {r["record_id"]: r["kind"] for r in tracker.orphans().collect()}


def test_orphans_replay(spark):
    rows = [(U(1), T(1), "a"), (U(1), T(20), "b"), (U(2), T(5), "c"), (U(2), T(5), "c"), (U(3), T(6), "d"), (None, T(6), "e"), (U(9), None, "f"), ("x", T(2), "g")]
    jobs = spark.createDataFrame([(U(1), T(10)), (U(1), T(12)), (U(4), None)], "job_id string, c timestamp")
    gone = spark.createDataFrame([(U(3).upper(), T(8)), (U(1), T(15))], "job_id string, d timestamp")
    tracker = orphans.replay(refs(spark, rows), orphans.parents(jobs, "job_id", "c"), orphans.deletions(gone, "job_id", "d"), keep_live=True)
    assert kinds(tracker) == {"a": "later", "c": "missing", "d": "deleted", "f": "missing"}
    assert sum(r["orphans"] for r in tracker.snapshot().collect()) == 4


def test_deletion_reopens_and_return_resolves(spark):
    t = orphans.OrphanTracker(spark)
    none_ref, none_del = refs(spark, []), orphans.deletions(spark.createDataFrame([], "j string, d timestamp"), "j", "d")
    job = lambda until: orphans.parents(spark.createDataFrame([(U(1), T(1))], "j string, c timestamp"), "j", "c", F.lit(until).cast("timestamp"))
    t.apply(refs(spark, [(U(1), T(2), "a"), (U(1), T(3), "a2")]), job("2026-01-05"), none_del)
    assert kinds(t) == {}
    t.apply(none_ref, job("2026-01-05"), orphans.deletions(spark.createDataFrame([(U(1), T(8))], "j string, d timestamp"), "j", "d"))
    assert kinds(t) == {"a": "deleted", "a2": "deleted"}
    t.apply(none_ref, job("2026-01-09"), none_del)
    assert kinds(t) == {}


def test_empty_orphans(spark):
    jobs = orphans.parents(spark.createDataFrame([], "j string, c timestamp"), "j", "c")
    gone = orphans.deletions(spark.createDataFrame([], "j string, d timestamp"), "j", "d")
    assert orphans.replay(refs(spark, []), jobs, gone).orphans().count() == 0


def test_compaction_and_snapshots(spark):
    """The state after every batch is the same with and without compaction; a hot parent is split over parts."""
    rng = random.Random(3)
    whole = [(U(rng.choice([1, 1, 1, 2, 3, 4, 5])), T(rng.randint(1, 28)), f"r{i}") for i in range(400)]
    jobs = spark.createDataFrame([(U(1), T(4)), (U(2), T(9)), (U(4), None), (U(5), T(20))], "j string, c timestamp")
    gone = spark.createDataFrame([(U(1), T(12)), (U(3), T(15)), (U(5), T(22))], "j string, d timestamp")
    parts = orphans.history(jobs, gone, "j", "c", "d")
    one = orphans.replay(refs(spark, whole), *parts, batches=5)
    two = orphans.replay(refs(spark, whole), *parts, batches=5, compact_after=2, salts=3, buckets=4)
    made = {1: 4, 2: 9, 4: 0, 5: 20}
    want = {r: "missing" if int(j[-1]) not in made and j != U(3) else "deleted" if j == U(3) else "later" for j, t, r in whole if int(j[-1]) not in made or made[int(j[-1])] > t.day}
    assert kinds(one) == kinds(two) == want
    snaps = lambda t: sorted(map(str, t.snapshots().collect()))
    assert snaps(one) == snaps(two)
    held = {r["batch"]: r["n"] for r in one.snapshots().groupBy("batch").agg(F.sum(F.when(F.col("kind") == "deleted", F.col("orphans"))).alias("n")).collect()}
    assert held[2] > held[4]  # job 1 was deleted, which reopened its references, and restored
    assert {(r["kind"], r["orphans"]) for r in one.snapshot().collect()} == {(r["kind"], r["orphans"]) for r in one.snapshots().where("batch = 4").collect()}


def test_batches_do_not_rewrite_history(spark):
    """What a batch writes does not grow with the batches before it."""
    t = orphans.OrphanTracker(spark)
    none_del = orphans.deletions(spark.createDataFrame([], "j string, d timestamp"), "j", "d")
    for n in range(3):
        jobs = spark.createDataFrame([(U(1000 + 100 * n + i), T(1)) for i in range(50)], "j string, c timestamp")
        t.apply(refs(spark, [(U(1000 + 100 * n + i), T(2), f"{n}-{i}") for i in range(80)]), orphans.parents(jobs, "j", "c"), none_del)
    per = lambda name: {r["batch"]: r["n"] for r in spark.table(name).groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert set(per(t.refs).values()) == {80} and set(per(t.index).values()) == {50} and len(kinds(t)) == 3 * 30


CORR = "correction_id string, occurred_at timestamp, event_type string, detector_source string, entity_label string, confidence double, text_hash string"


def test_audit(spark):
    rows = [(str(i), T(1 + i), "false_positive", None if i == 4 else "ner", "Person", 0.5 + i / 10, "h1" if i < 3 else "h2") for i in range(5)] + [("9", T(9), "relabel", "regex", "Date", float("nan"), None)]
    df = spark.createDataFrame(rows, CORR)
    hint = {r["source"]: r for r in audit.threshold_hints(df).collect()}
    assert (hint["ner"]["n"], hint["ner"]["p50"], hint["ner"]["p90"], hint["ner"]["suggested"]) == (4, 0.6, 0.7, 0.71)
    assert [r["n"] for r in audit.repeated(df).collect()] == [3]
    assert audit.recent(df, 2).first()["correction_id"] == "9"
    by = {r["entity_label"]: r for r in audit.pivot(df, "entity_label").collect()}
    assert by["Person"]["false_positive"] == 5 and by["Date"]["false_negative"] == 0
    assert audit.training_export(df.withColumn("engine_version", F.lit("1")), label="Date").count() == 1
    assert audit.threshold_hints(df.limit(0)).count() == 0


def test_policy(spark):
    overlay = policy.read(spark, '{"Email": false, "Date": 1, "New": false}')
    eff = policy.effective(policy.catalog(spark), overlay)
    assert policy.disabled(eff) == ["Email"] and eff.count() == 26
    new = policy.update(eff, policy.read(spark, '{"Email": true, "Date": false, "Nope": false}'))
    assert policy.disabled(new) == ["Date"] and policy.disabled(policy.effective(policy.catalog(spark), policy.read(spark, "broken"))) == []


SPAN = "doc_id string, start int, end int, label string, source string"


def slow_relaxed(gold, pred):
    tp = 0
    used = set()
    for d, a, b, lab, _ in gold:
        for i, (e, x, y, lb, _) in enumerate(pred):
            if i not in used and d == e and lab == lb and a < y and b > x:
                used.add(i)
                tp += 1
                break
    return tp


@pytest.mark.parametrize("seed", [1, 2])
def test_scores(spark, seed):
    r = random.Random(seed)
    make = lambda n: sorted((str(r.randint(0, 2)), a := r.randint(0, 80), a + r.randint(1, 9), r.choice("AB"), r.choice(["regex", "ner"])) for _ in range(n))
    gold, pred = make(40), make(40)
    pred[:10] = gold[:10]
    pred.sort()
    g, p = spark.createDataFrame(gold, SPAN), spark.createDataFrame(pred, SPAN)
    gs, ps = {x[:4] for x in gold}, {x[:4] for x in pred}
    m = evaluate.micro(evaluate.strict(g, p)).first()
    assert (m["tp"], m["fp"], m["fn"]) == (len(gs & ps), len(ps - gs), len(gs - ps))
    rel = evaluate.micro(evaluate.relaxed(g, p)).first()
    assert (rel["tp"], rel["fp"], rel["fn"]) == (slow_relaxed(gold, pred), 40 - slow_relaxed(gold, pred), 40 - slow_relaxed(gold, pred))
    chars = lambda rows: {(d, i) for d, a, b, *_ in rows for i in range(a, b)}
    c = evaluate.leak(evaluate.characters(g, p)).first()
    assert (c["gold_chars"], c["pred_chars"], c["shared_chars"]) == (len(chars(gold)), len(chars(pred)), len(chars(gold) & chars(pred)))
    assert evaluate.errors(g, p).count() == len(gs ^ ps)


def test_empty_scores(spark):
    none = spark.createDataFrame([], SPAN)
    assert evaluate.micro(evaluate.strict(none, none)).first()["f1"] == 0.0
    assert evaluate.leak(evaluate.characters(none, none)).first()["leak"] == 0.0
    assert evaluate.relaxed(none, none).count() == 0


def test_markup(spark):
    df = spark.createDataFrame([("a [[Ali|Person]] b🙂 [[x y|Date]]",), ("plain",)], "raw string")
    got = [r["m"] for r in df.select(evaluate.parse_markup("raw").alias("m")).collect()]
    assert got[0]["text"] == "a Ali b🙂 x y" and [(s["start"], s["end"], s["label"]) for s in got[0]["spans"]] == [(2, 5, "Person"), (9, 12, "Date")]
    assert got[1]["text"] == "plain" and got[1]["spans"] == []


def docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Bir") + p(" ") + f"<w:tbl><w:tr><w:tc>{p('hücre')}</w:tc></w:tr></w:tbl>" + p("İki")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return buf.getvalue()


def test_extract(spark, tmp_path):
    for name, data in (("a.docx", docx()), ("b.pdf", b"x"), ("c.xyz", b"x"), ("d.docx", b"broken"), ("e.PNG", b"x")):
        (tmp_path / name).write_bytes(data)
    files = extract.read_files(spark, str(tmp_path))
    ocr = lambda data, page: ("taranmış", [90.0, -1.0, 80.0])
    got = {r["filename"]: r for r in extract.extract(files, lambda data: ["x" * 30, "kısa", "  "], ocr).collect()}
    assert got["a.docx"]["pages"][0]["text"] == "Bir\nİki\nhücre"
    assert [p["extract_method"] for p in got["b.pdf"]["pages"]] == ["native", "ocr", "ocr"]
    assert got["c.xyz"]["error_message"].startswith("Unsupported") and got["d.docx"]["error_message"] and got["e.PNG"]["pages"][0]["confidence"] == 85.0
    df = extract.extract(files, lambda data: ["x" * 30, "kısa", "  "], ocr).where("filename = 'b.pdf'")
    r = df.select(extract.full_text(F.col("pages")).alias("t"), extract.page_breaks(F.col("pages")).alias("b"), extract.ocr_mean(F.col("pages")).alias("m")).first()
    assert r["t"] == "x" * 30 + "\ftaranmış\ftaranmış" and r["b"] == [0, 31, 40] and r["m"] == 85.0


def test_store(spark):
    now = F.lit("2026-01-01").cast("timestamp")
    masked = spark.createDataFrame([("j", {"{A_1}": "x", "{A_2}": "y"}), ("k", {})], "id string, mapping map<string,string>")
    rows = store.mapping_rows(masked, "id", now, 60)
    assert rows.count() == 2 and store.lookup(rows, "j", now, "{A_1}").first()["original"] == "x"
    ask = spark.createDataFrame([("j", "{A_2} {B_1}"), ("k", "{A_1}")], "job_id string, masked_text string")
    assert {(r["job_id"], r["text"], r["status"]) for r in store.restore(ask, rows, now).collect()} == {("j", "y {B_1}", "ok"), ("k", "{A_1}", "missing")}
    assert {(r["job_id"], r["seconds"]) for r in store.remaining(ask, rows, now).collect()} == {("j", 60), ("k", -2)}
    assert store.deleted(rows, ask).count() == 0
    later = F.lit("2026-01-02").cast("timestamp")
    left, events = streams.expired(rows, later)
    assert left.count() == 0 and events.first()["placeholder_count"] == 2


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("j1", "a@b.co"), ("j2", "yok")], "job_id string, text string").write.parquet(str(src))
    from veilwright.operators.masking import Settings

    stream = streams.mask_stream(spark, str(src), spark.read.parquet(str(src)).schema, settings=Settings(mode="regex"))
    out, maps = str(tmp_path / "out"), str(tmp_path / "maps")
    streams.write_masked(stream, "job_id", out, maps, str(tmp_path / "cp")).awaitTermination()
    assert {r["masked_text"] for r in spark.read.parquet(out).collect()} == {"{Email_1}", "yok"}
    assert spark.read.parquet(maps).first()["original"] == "a@b.co"


def test_committed_appends(spark, tmp_path):
    """Rows of several tables count together or not at all; what cannot be read is an empty table."""
    root = str(tmp_path / "sinks")
    raw = spark.createDataFrame([("j1", "Ali", "Person", "ner"), ("j2", "Veli", "Person", "regex")], "job_id string, text string, entity_label string, detector_source string")
    sinks = audit.correction_sinks(raw, F.lit("2026-01-01").cast("timestamp"))
    assert store.append_together(sinks, root) and store.append_together(sinks, root)
    read = lambda n: store.read_together(spark, root, n, "job_id string, text string, text_hash string, event_type string").collect()
    assert len(read("corrections")) == len(read("examples")) == len(read("audit_log")) == 4
    assert {r["text"] for r in read("corrections")} == {None} and {r["text"] for r in read("examples")} == {"Ali", "Veli"}
    broken = {"corrections": raw, "audit_log": raw.select(F.raise_error(F.lit("full disk")).alias("job_id"))}
    assert store.append_together(broken, root) is None
    assert len(read("corrections")) == 4
    assert read("nothing") == [] and store.read_or_empty(spark, str(tmp_path / "no"), "a int, b string").columns == ["a", "b"]


def test_policy_file(spark, tmp_path):
    at = str(tmp_path / "sub" / "policy.json")
    assert policy.load(at) is None
    wanted = policy.update(policy.effective(policy.catalog(spark), policy.read(spark, None)), spark.createDataFrame([("Email", False)], "label string, enabled boolean"))
    policy.save(wanted, at)
    again = policy.effective(policy.catalog(spark), policy.read(spark, policy.load(at)))
    assert policy.disabled(again) == ["Email"] and sorted(map(tuple, again.collect())) == sorted(map(tuple, wanted.collect()))


def test_model_source_and_health(tmp_path):
    from veilwright.operators import ner

    here = str(tmp_path)
    assert ner.model_source("x", [here], "hub") == "x" and ner.model_source(None, ["/no/such", here], "hub") == here and ner.model_source("", ["/no/such"], "hub") == "hub"
    assert store.health(True) == {"status": "ok", "service": "veilwright", "ner_available": True}


def test_sentences(spark, tmp_path):
    from veilwright.operators import training

    rows = training.sentences(spark, 300).collect()
    assert rows == training.sentences(spark, 300).collect() != training.sentences(spark, 300, seed=14).collect()
    for r in rows:
        assert len(r["tokens"]) == len(r["tags"])
        for before, tag in zip(["O", *r["tags"]], r["tags"]):
            assert not tag.startswith("I-") or before[2:] == tag[2:]
    store.write_jsonl(training.sentences(spark, 300), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).count() == 300


def test_requests_and_unreadable_paths(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"text": "a"}\n{"text": "b", "mode": "ner", "language": "tr", "manual_spans": [{"text": "x", "label": "Person"}]}\n')
    got = {r["text"]: r for r in extract.read_requests(spark, str(tmp_path / "r.json")).collect()}
    assert got["a"]["mode"] == "full" and got["b"]["mode"] == "ner" and got["b"]["manual_spans"][0]["label"] == "Person"
    row = extract.extract(extract.read_files(spark, str(tmp_path / "missing.pdf"))).first()
    assert row["filename"] == "missing.pdf" and row["error_message"] == "cannot read file" and row["pages"] == []
