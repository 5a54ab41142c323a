import json
import os

from pyspark.sql import functions as F

from plumbline.functions import settings
from plumbline.sources import sinks
from plumbline.streaming import ledgers

ROWS = [(i, f"2024-0{1 + i % 2}", f"t{i % 3}", "scan", float(i)) for i in range(30)]


def test_stream_equals_batch(spark, tmp_path):
    for batch, half in (("a", ROWS[:15]), ("b", ROWS[15:]), ("a", ROWS[:15])):  # the first is tried again
        ledgers.append(spark.createDataFrame(half, ledgers.COSTS), str(tmp_path / "costs"), batch)
    q = ledgers.run(ledgers.spend(ledgers.entries(spark, str(tmp_path / "costs"), ledgers.COSTS)), "spend", str(tmp_path / "c1"))
    q.awaitTermination(60)
    want = {(r.period, r.team): r.spent for r in ledgers.spend(spark.createDataFrame(ROWS, ledgers.COSTS)).collect()}
    assert {(r.period, r.team): r.spent for r in spark.table("spend").collect()} == want


def test_first_seen_over_files(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"seq": i, "fingerprint": f"p{i % 4}", "finding": "x"}) for i in range(8)))
    q = ledgers.run(ledgers.first_seen(ledgers.ledger(spark, str(folder), ledgers.FINDINGS)), "seen", str(tmp_path / "c2"), "append")
    q.awaitTermination(60)
    assert spark.table("seen").count() == 4


def test_audit_hash_is_of_the_row_alone(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, what string")
    one, two = (ledgers.audited(x).filter("id = 1").first().entry_hash for x in (df, df.select("what", "id").filter("id = 1")))
    assert one == two and len(one) == 64


def test_sarif_documents(spark):
    rows = spark.createDataFrame([("r", "error", "a.py", 1, "m", "f1"), ("r", "note", "a.py", 2, "m", "f2"), ("q", "note", "b.py", 1, "m", "f3")], "rule string, level string, uri string, line int, message string, fingerprint string")
    got = {r.uri: json.loads(r.document) for r in sinks.sarif(rows).collect()}
    assert len(got["a.py"]["runs"][0]["results"]) == 2 and got["b.py"]["version"] == "2.1.0"


def test_settings(spark):
    base = {"a": {"x": 1, "y": 2}, "b": 1}
    over = settings.from_environment({"APP_A__X": "5", "APP_B": "3", "OTHER_A__Y": "9"}, "APP")
    assert settings.merged(base, over) == {"a": {"x": 5, "y": 2}, "b": 1}
    reg = settings.Registry()
    reg.register("one", lambda d: d.select(F.lit("one").alias("scanner")))
    reg.register("two", lambda d: d.select(F.lit("two").alias("scanner"), F.lit(1).alias("extra")))
    assert reg.scan(spark.range(2)).count() == 4
    assert os.path.sep


def test_scores_add_up_over_batches(spark, tmp_path):
    from plumbline.operators.scoring import reprioritise
    from plumbline.plans import catalogue  # noqa: F401
    from plumbline.plans.scoring import EVENTS
    from plumbline.sources import adaptors

    from .conftest import DATA

    shape = "eseq int, kind string, target string, boost double, ratio double"
    names = ["eseq", "kind", "target", "boost", "ratio"]
    folder = tmp_path / "events"
    folder.mkdir()
    for k, e in enumerate(EVENTS):
        file = folder / f"{k}.json"
        file.write_text(json.dumps(dict(zip(names, e, strict=True))))
        os.utime(file, (1_000_000 + k, 1_000_000 + k))
    findings = adaptors.findings(spark, DATA)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).json(str(folder))
    ledgers.rescored(stream, findings, str(tmp_path / "scores"), str(tmp_path / "c")).awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "scores" / f"batch={len(EVENTS) - 1}"))
    got = {r.seq: (r.priority_score, r.paused, r.n_boosts) for r in last.collect()}
    want = {r.seq: (r.priority, r.paused, r.n_boosts) for r in reprioritise(findings, spark.createDataFrame(EVENTS, shape)).collect()}
    assert got == want
