"""Operators with state, order or nearness against plain Python over random rows."""

import datetime as dt
import random
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmark.operators import admission, evaluate, guardrails, identity, lifecycle, register, trainset
from quillmark.plans import catalogue, q_cases, q_streams, views
from quillmark.sources.scratch import scratch
from quillmark.sources.snapshots import Snapshots
from quillmark.streaming import streams

ROOT = Path(__file__).resolve().parents[1]
START = dt.datetime(2024, 3, 1)


def reports(n=600, seed=1):
    rng = random.Random(seed)
    return [(i, f"t{rng.randint(0, 1)}", rng.choice(["Fuga de aceite", "fuga, de ACEITE", "Etiqueta rota"]), START + dt.timedelta(hours=rng.randint(0, 24 * 30))) for i in range(n)]


def plain_suppressed(rows, recent=50):
    last, out = defaultdict(list), {}
    for i, tenant, text, at in sorted(rows, key=lambda r: (r[3], r[0])):
        text = text.lower().replace(",", "")
        same = [k for t, x, k in last[tenant] if x == text and at - t <= dt.timedelta(hours=24)]
        if not same:
            last[tenant] = [*last[tenant], (at, text, i)][-recent:]
        out[i] = not same, same[-1] if same else i
    return out


REPORT = "id long, tenant_id string, description string, created_at timestamp"


@pytest.mark.parametrize("recent", [1, 2, 50])
def test_duplicates_within_a_day(spark, recent):
    rows = reports()
    d = spark.createDataFrame(rows, REPORT).repartition(7).withColumn("key", F.lit("clash"))
    got = {r["id"]: (r["kept"], r["original_id"]) for r in lifecycle.suppress_duplicates(d, recent).collect()}
    assert got == plain_suppressed(rows, recent)
    assert lifecycle.suppress_duplicates(d.limit(0)).count() == 0


def test_duplicates_with_and_without_crowded_tenants(spark):
    """Tenant c keeps more than 20 reports a day; a report without time, of either tenant, is kept and suppresses none."""
    rng = random.Random(8)
    rows = reports(200) + [(1000 + i, "c", f"caso {rng.randint(0, 60)}", START + dt.timedelta(minutes=7 * i)) for i in range(900)]
    d = spark.createDataFrame([*rows, (5000, "c", "caso 1", None), (5001, "t0", "Etiqueta rota", None)], REPORT)
    got = {r["id"]: (r["kept"], r["original_id"]) for r in lifecycle.suppress_duplicates(d, 20).collect()}
    assert got == plain_suppressed(rows, 20) | {5000: (True, 5000), 5001: (True, 5001)}
    assert plain_suppressed(rows, 20) != plain_suppressed(rows, 1000)


def test_duplicates_in_small_batches(spark):
    """What a crowded tenant has kept is carried from one Arrow batch to the next."""
    rows = reports(400, 2)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["id"]: (r["kept"], r["original_id"]) for r in lifecycle.suppress_duplicates(spark.createDataFrame(rows, REPORT), 1).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == plain_suppressed(rows, 1)


def streamed(spark, files, schema, build):
    """What a stream makes of files that arrive one by one; a last row lets the watermark pass all others."""
    source, out, state = (scratch(spark, n) for n in ("in", "out", "state"))
    names = [c.split()[0] for c in schema.split(", ")]
    end = tuple(START + dt.timedelta(days=4000) if n in ("ts", "created_at") else None for n in names)
    for rows in [*files, [end]]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    build(stream).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


@pytest.mark.parametrize("recent", [2, 50])
def test_stream_of_duplicates_in_shuffled_batches(spark, recent):
    """Batches in any order within the delay give what the batch form gives."""
    rows = reports(120, 3)
    random.Random(1).shuffle(rows)
    out = streamed(spark, [rows[k::5] for k in range(5)], REPORT, lambda r: streams.suppress_duplicates(r, "40 days", recent))
    assert not any(r["late"] for r in out)
    assert {r["id"]: (r["kept"], r["original_id"]) for r in out} == plain_suppressed(rows, recent)


def test_stream_of_admissions_with_late_rows(spark):
    """Rows behind the watermark come out as late, without a verdict, and change no other; silent keys are forgotten."""
    rng = random.Random(4)
    rows = sorted(((i, rng.choice("ab"), START + dt.timedelta(seconds=rng.randint(0, 900))) for i in range(80)), key=lambda r: (r[2], r[0]))
    late = [(500, "a", START), (501, "c", START + dt.timedelta(seconds=1))]
    schema = "id long, key string, ts timestamp"
    out = streamed(spark, [rows[:40], rows[40:60], rows[60:] + late], schema, lambda e: streams.sliding_window(e, 2, late="10 seconds"))
    assert {r["id"] for r in out if r["late"]} == {500, 501} and all(r["admitted"] is None for r in out if r["late"])
    seen, want = defaultdict(list), {}
    for i, key, ts in rows:
        seen[key] = [t for t in seen[key] if t >= ts - dt.timedelta(seconds=60)]
        want[i] = len(seen[key]) < 2
        seen[key] += [ts] * want[i]
    assert {r["id"]: r["admitted"] for r in out if not r["late"]} == want
    assert {r["id"]: r["admitted"] for r in admission.sliding_window(spark.createDataFrame(rows, schema), 2).collect()} == want


def test_counts_equal_the_batch_query_after_every_batch(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 30), START + dt.timedelta(minutes=i), rng.choice(["a", "b", None]), rng.choice(["x", "y"])) for i in range(200)]
    rng.shuffle(rows)
    schema, source, seen = "id long, ts timestamp, area string, status string", scratch(spark, "in"), []
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : k * 50 + 50], schema).coalesce(1).write.mode("append").parquet(source)
    table = Snapshots(spark, scratch(spark, "counts"), ["area", "status"])
    table.create(spark.createDataFrame([], "area string, status string, n long"))

    def after(number):
        latest = {}
        for i, ts, area, status in rows[: number * 50 + 50]:
            latest[i] = max(latest.get(i, (START, None, None)), (ts, area, status), key=lambda r: r[0])
        want = Counter(r[1:] for r in latest.values())
        seen.append({(r["area"], r["status"]): r["n"] for r in table.read().collect()} == want)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.count_latest(stream, ["area", "status"], table, scratch(spark, "state"), after).awaitTermination()
    assert len(seen) == 4 and all(seen)


def words(doc, *rows):
    return [(doc, 600.0, t, float(x0), float(x0 + 40), float(top)) for t, x0, top in rows]


BLOCK_COLUMNS = "doc_id long, page_width double, text string, x0 double, x1 double, top double"


def test_approval_block_by_place(spark):
    labels = (("ELABORADO", 60, 100), ("POR:", 105, 100), ("REVISADO", 260, 101), ("APROBADO:", 460, 100))
    rows = words(1, *labels, ("JEFE", 50, 120), ("TI", 95, 122), ("COORDINADOR", 250, 123.5), ("GERENTE", 450, 120), ("GENERAL", 500, 132), ("Esta", 50, 150), ("prohibida", 95, 150), ("nada", 450, 165))
    rows += words(2, ("ELABORADO", 60, 10), ("texto", 60, 30), *((t, x0, top + 200) for t, x0, top in labels), *((f"l{k}", 60, 320 + 10 * k) for k in range(5)))
    rows += words(3, ("sin", 10, 10), ("firmas", 60, 10))
    # heights that drift: a line takes in what is within the gap of its first word, not of its last
    rows += words(4, ("APROBADO", 460, 100), ("uno", 440, 120), ("dos", 480, 123), ("tres", 460, 126))
    got = {r["doc_id"]: (r["prepared_by"], r["reviewed_by"], r["approved_by"]) for r in identity.approval_blocks(spark.createDataFrame(rows, BLOCK_COLUMNS)).collect()}
    assert got == {1: ("JEFE TI", "COORDINADOR", "GERENTE GENERAL"), 2: ("l0 l1 l2", None, None), 3: (None, None, None), 4: (None, None, "uno dos tres")}
    assert identity.approval_blocks(spark.createDataFrame([], BLOCK_COLUMNS)).count() == 0


def test_caps_and_splits_keep_groups_whole(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["cita", "cita", "otra", "rara"]), f"g{rng.randint(0, 60)}") for i in range(800)]
    d = spark.createDataFrame(rows, "id long, family string, grp string")
    sizes = defaultdict(int)
    for _, f, g in rows:
        sizes[f, g] += 1
    kept = trainset.capped(d, "cita", 150).toPandas()
    own = kept[kept["family"] == "cita"].groupby("grp").size()
    assert all(n == sizes["cita", g] for g, n in own.items()) and 150 <= own.sum() < 150 + max(sizes.values())
    assert (kept["family"] != "cita").sum() == sum(f != "cita" for _, f, _ in rows)
    parts = trainset.split(d, 0.1, 0.1).toPandas()
    assert len(parts) == len(rows) and parts.groupby("grp")["particion"].nunique().max() == 1
    held = parts[["family", "grp", "particion"]].drop_duplicates().groupby(["family", "particion"]).size()
    for family in ("cita", "otra", "rara"):
        assert held[family, "valid"] >= max(1, round(0.1 * len({g for f, g in sizes if f == family})))


def test_attribution_needs_two_words_of_one_title(spark):
    answers = spark.createDataFrame([(1, "t", "Lo define el procedimiento de atencion de solicitudes"), (2, "t", "Lo define el manual de atencion de compras"), (3, "t", "atencion de solicitudes")], "id long, tenant_id string, answer string")
    titles = spark.createDataFrame([("t", "A", "Atención de Solicitudes"), ("t", "B", "Atención urgente"), ("t", "B", "Compras menores"), ("u", "C", "Atención de Solicitudes")], "tenant_id string, code string, title string")
    assert {r["id"]: r["named"] for r in evaluate.attribution(answers, titles).collect()} == {1: ["A"], 2: [], 3: []}


@pytest.mark.parametrize("view", ["v_pages", "v_chunks"])
def test_views_hold_whole_texts(spark, tmp_path, view):
    texts = ["x" * n for n in (0, 1, 1500, 1501, 2000, 2001, 9999)] + ["é" * 4321]
    spark.createDataFrame([(i, t, "es", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0], i % 2) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = views.frame(spark, str(tmp_path), view).toPandas()
    if view == "v_pages":
        got = v.sort_values("page_no").groupby("doc_id")["text"].apply(lambda t: "".join(p.split("\n")[1 if p.count("\n") == 2 else 2] for p in t))
    else:
        got = v.sort_values("id").groupby("document_id")["content"].apply(lambda t: "".join(p.split(" ", 2)[2] for p in t))
    assert {i: len(t.replace("nada", "")) for i, t in got.items()}.keys() == set(range(len(texts)))
    if view == "v_chunks":
        assert got.to_dict() == dict(enumerate(texts))
    else:
        assert v.groupby("doc_id").size().to_dict() == {i: max(1, -(-len(t) // 1500)) for i, t in enumerate(texts)}


BLOCKED = """
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
print("N", len(e.queries()), len(e.oracle_sql()))
"""


@pytest.mark.parametrize("blocked", [("xxhash",), ("corpus_pipeline",)])
def test_entry_without_what_the_training_data_operators_need(blocked):
    out = subprocess.run([sys.executable, "-c", BLOCKED.format(blocked=set(blocked))], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n = [int(x) for x in out.stdout.split("N")[-1].split()]
    assert n[0] >= n[1] >= 190


def test_scratch_needs_a_shared_folder_on_clusters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(RuntimeError):
        scratch(Session(), "x")


def test_a_stream_calls_its_state_by_bucket(spark):
    """the state store is called for buckets, not for rows and keys, of which there may be any number."""
    keys, per = 3000, 4
    rows = [(k * per + j, f"k{k}", START + dt.timedelta(seconds=40 * j + k % 7)) for k in range(keys) for j in range(per)]
    random.Random(4).shuffle(rows)
    schema = "id long, key string, ts timestamp"
    out = streamed(spark, [rows[::2], rows[1::2]], schema, lambda e: streams.sliding_window(e, 1, late="1 day"))
    got = {r["id"]: r["admitted"] for r in out if not r["late"]}
    batch = {r["id"]: r["admitted"] for r in admission.sliding_window(spark.createDataFrame(rows, schema), 1).collect()}
    assert {i: got[i] for i in batch} == batch and len(set(batch.values())) == 2


def test_a_bucket_takes_rows_in_blobs(spark):
    """rows wait as blobs, not one by one; what is kept of a key is no longer than its rule needs it."""

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        put = update

        def appendList(self, values):  # noqa: N802
            calls.append(len(values))
            self.value = [*(self.value or []), *values]

        def clear(self):
            self.value = None

    class Handle:
        def getListState(self, *_):  # noqa: N802
            return State()

        getValueState = getListState  # noqa: N815

        def registerTimer(self, at):  # noqa: N802
            pass

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    calls = []
    n = 20000
    p = streams.InOrder({}, {"ok": "boolean"}, lambda state, at, ids: (None, [True] * len(at)), 1000)
    p.init(Handle())
    rows = pd.DataFrame({"key": [f"k{i % 900}" for i in range(n)], "at": [1000 * i for i in range(n)], "id": range(n), "blank": False})
    assert sum(map(len, p.handleInputRows((0,), iter([rows]), Now(0)))) == 0 and calls == [-(-n // streams.BLOB)]
    half = pd.concat(p.handleExpiredTimer((0,), Now(10_000), None))
    rest = pd.concat(p.handleExpiredTimer((0,), Now(50_000), None))
    assert sorted(half["id"]) == list(range(10_000)) and sorted(rest["id"]) == list(range(10_000, n))
    assert not p.waiting.exists() and not p.keys.exists() and not p.clock.exists()


def test_rows_come_to_a_stream_as_blobs(spark):
    """Spark hands rows to a stateful processor one by one, so rows are dealt to buckets as blobs before."""
    schema = pa.schema({"key": pa.string(), "at": pa.int64(), "id": pa.int64(), "blank": pa.bool_()})
    n = 100_000
    rows = pa.table({"bucket": pa.array([i % 3 for i in range(n)], pa.int64()), "key": [f"k{i % 3}" for i in range(n)], "at": range(n), "id": range(n), "blank": [False] * n})
    out = pa.Table.from_batches(streams._dealt(schema)(iter(rows.to_batches(10_000))))
    assert len(out) == 3 * -(-n // 3 // streams.BLOB)
    for bucket, blob in zip(out["bucket"].to_pylist(), out["rows"].to_pylist()):
        part = pa.ipc.open_stream(blob).read_all()
        assert part.schema == schema and set(part["key"].to_pylist()) == {f"k{bucket}"}
    assert sorted(i for b in out["rows"].to_pylist() for i in pa.ipc.open_stream(b).read_all()["id"].to_pylist()) == list(range(n))


def test_a_large_slice_of_a_stream_has_several_files(spark, monkeypatch):
    """a batch of one file is prepared by one task; the results don't depend on the number of files."""
    monkeypatch.setattr(q_streams, "FILE_ROWS", 100)
    made = []

    def build(rows, late):
        made.extend(spark.read.schema(rows.schema).parquet(made[0]).inputFiles())
        return streams.sliding_window(rows, 1, late=late)

    real = q_streams.scratch
    monkeypatch.setattr(q_streams, "scratch", lambda s, name: made.append(real(s, name)) or made[-1] if name == "stream-in" else real(s, name))
    rows = spark.range(9000).selectExpr("id", "concat('k', id % 7) AS key", "timestamp_seconds(1700000000 + id * 40) AS ts")
    got = {r["id"]: r["admitted"] for r in q_streams.drained(spark, rows, "ts", build).collect() if r["id"] is not None}
    assert got == {r["id"]: r["admitted"] for r in admission.sliding_window(rows, 1).collect()}
    assert len(made) - 1 > 2 * q_streams.SLICES


def test_files_of_one_path_are_taken_by_id(spark):
    """files of equal code, content and path; whatever order they come in, the smallest id is first."""
    rows = [(i, "t", "STI-PR-01", f"a/{i % 2}.pdf", "same", "titulo") for i in range(40)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        files = spark.createDataFrame(rows, "id long, tenant_id string, code string, path string, content string, title string").repartition(5)
        assert [r["id"] for r in register.same_content_once(files).collect()] == [0]
        codes = {r["id"]: r["code"] for r in register.distinct_codes(files).collect()}
        order = sorted(codes, key=lambda i: (i % 2, i))
        assert [codes[i].rpartition("#")[2] for i in order[1:]] == [str(k) for k in range(2, 41)]


def test_of_requests_that_repeat_an_id_the_first_of_the_table_holds(spark, tmp_path):
    """rows of equal id and other tenants, in two files."""
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"
    rows = [(k, 1, k % 5, s) for s in range(4) for k in range(300)]
    for k, part in enumerate((rows[:700], rows[700:])):
        spark.createDataFrame(part, names).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{k}"))
        next((tmp_path / f"{k}").glob("*.parquet")).rename(tmp_path / f"part-{k}.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(2):
        (tmp_path / f"part-{k}.parquet").rename(tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    got = q_cases.requests(spark, str(tmp_path)).collect()
    assert len(got) == 300 and {r["tenant_id"] for r in got} == {"tenant-0"}


@pytest.mark.parametrize("name", ["L3_findings_after", "L3_register_action"])
def test_actions_on_several_files_equal_their_sql_run_by_one_thread(spark, tmp_path, name):
    """the SQL leaves open which row of an id it takes; one thread reads files in order and takes the table's first."""
    duckdb = pytest.importorskip("duckdb")
    n = 300
    tables = {"lineitem": tmp_path / "lineitem.parquet", "orders": tmp_path / "orders.parquet"}
    for path in tables.values():
        path.mkdir()
    for k in range(4):
        items = {"l_orderkey": range(n), "l_linenumber": pa.array([4] * n, pa.int32()), "l_partkey": [25] * n, "l_suppkey": [(i + k) % 4 for i in range(n)], "l_shipdate": [START] * n, "l_linestatus": ["F"] * n, "l_returnflag": ["R"] * n}
        pq.write_table(pa.table(items), tables["lineitem"] / f"part-{k}.parquet")
    found = {"o_orderkey": range(n), "o_custkey": [0] * n, "o_orderstatus": ["O"] * n, "o_orderpriority": ["1-URGENT"] * n, "o_orderdate": [START] * n}
    pq.write_table(pa.table(found), tables["orders"] / "part-0.parquet")
    con = duckdb.connect(config={"threads": 1})
    for table, path in tables.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(catalogue.ORACLES[name]).fetchall()
    assert sorted(Counter(r[-1] for r in want).values()) == [75, 225]
    assert sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_lists_of_documents_are_made_for_codes_not_for_uploads(spark):
    """What is made of the stock has a row for each code and version that comes in, and verdicts need no list."""
    docs = spark.createDataFrame([(i, "t", "STI-PR-01", f"v{1 + i % 40}", "vigente" if i % 3 else "obsoleto") for i in range(400)], "id long, tenant_id string, code string, version string, status string")
    columns = "id long, tenant_id string, filename string, header_code string, header_version string, approved_by string"
    ups = spark.createDataFrame([(i, "t", "escaneo.pdf", "STI-PR-01" if i % 9 else None, f"v{1 + i % 4}", "Jefe") for i in range(200)], columns)
    registry = spark.createDataFrame([("t", "STI-PR-01", "v2", START.date())], "tenant_id string, code string, version string, effective_date date")
    asked = ups.select("id", "tenant_id", F.col("header_code").alias("code"), F.col("header_version").alias("version"))
    assert identity._held(asked, docs).count() == 4
    got = {r["id"]: r for r in identity.assess(ups, registry, docs).collect()}
    for i, r in got.items():
        lists = {a["code"]: a["detail"] for a in r["advices"]}
        of = lambda test: ",".join(str(k) for k in range(400) if test(k % 40, i % 4, k % 3))  # noqa: E731, B023
        want = {"older_than_registered": of(lambda n, v, s: n > v), "same_version_exists": of(lambda n, v, s: n == v), "supersedes_previous": of(lambda n, v, s: n < v and s)} if i % 9 else {}
        assert {k: v for k, v in lists.items() if k in identity.LISTED} == {k: v for k, v in want.items() if v}
        assert (r["blocking"], r["needs_review"]) == ("no_code" in lists, True) and r["n_advices"] == len(lists)
    plan = identity.assess(ups, registry, docs).select("id", "needs_review")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the driver's tables")
def test_clauses_are_cut_before_they_meet_their_vectors(spark):
    """What Spark runs has the rows of the view, and whole texts don't go through its join."""
    sf = "/root/testdata/sf0.001"
    ours, view = views.frame(spark, sf, "v_chunks"), views.sql(spark, sf, views.VIEWS["v_chunks"])
    rows = lambda df: sorted(map(tuple, df.drop("embedding").collect()))
    assert ours.dtypes == view.dtypes and rows(ours) == rows(view)
    plan = ours.drop("embedding")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join ") < plan.index("substr")


@pytest.mark.parametrize("labels", [0, 1_000_000])
def test_texts_of_clauses_are_not_shuffled(spark, monkeypatch, labels):
    """Clauses without their vectors need labels alone, which are broadcast up to a count, whatever the automatic size."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(views, "LABELS", labels)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ours = views.sql(spark, sf, "SELECT * FROM {v_chunks}")
        plan = ours._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning" in plan) == (labels == 0)
        columns = ["id", "document_id", "tenant_id", "section", "content", "label"]
        assert ours.columns == columns
        view = views.sql(spark, sf, views.VIEWS["v_chunks"]).select(columns)
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, view.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_texts_move_once_to_answers(spark):
    """The clauses of an answer's document and the first one of the next come from one scan of the clauses."""
    sf = "/root/testdata/sf0.001"
    ours, view = views.frame(spark, sf, "v_retrieved"), views.sql(spark, sf, views.VIEWS["v_retrieved"])
    assert ours.schema.simpleString() == view.schema.simpleString()
    assert Counter(map(tuple, ours.collect())) == Counter(map(tuple, view.collect())) and ours.count()
    plan = ours._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count(" AS piece") == 1


def test_citations_of_the_catalogue_are_distinct_before_they_meet(spark):
    """pairs of answers and documents are made once each, and only ids of several tenants are made distinct afterwards."""
    answers = spark.createDataFrame([(1, "a", "ver STI-PR-01 y STI-PR-01"), (1, "a", "STI-PR-01"), (2, "a", "STI-PR-01"), (2, "b", "STI-PR-01"), (3, None, "STI-PR-01")], "id long, tenant_id string, answer string")
    docs = spark.createDataFrame([(t, f"STI-PR-01{q}", "v1", "vigente") for t in "ab" for q in ("", "", " (x)")], "tenant_id string, code string, version string, status string")
    got = guardrails.catalogue_citations(answers, docs)
    assert sorted(map(tuple, got.collect())) == [(i, f"STI-PR-01{q}", "v1") for i in (1, 2) for q in ("", " (x)")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Union")
