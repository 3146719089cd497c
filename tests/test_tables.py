"""Merge, versioned tables, ingest, streams, flows, policies, jobs, churn."""

import json
import threading
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import churn, merge
from quarry.operators.merge import Clause
from quarry.plans import flows, policies
from quarry.plans.runner import Job, Task
from quarry.settings import Settings, can, conf, scalar, session, table_exists
from quarry.sources import files, landing, synthetic
from quarry.sources.versioned import VersionedTable
from quarry.streaming import sinks, windows

DAY = [datetime(2026, 1, d) for d in range(1, 20)]


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id long, v string")


def test_merge_clauses(spark, target):
    source = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e"), (None, "m")], "id long, v string")
    assert pairs(merge.merge(target, source, ["id"])) == sorted([(1, "a"), (2, "c"), (None, "n"), (3, "d"), (3, "e"), (None, "m")], key=str)
    assert pairs(merge.merge(target, source, ["id"], merge.INSERT_ONLY)) == sorted([(1, "a"), (2, "b"), (None, "n"), (3, "d"), (3, "e"), (None, "m")], key=str)
    how = [Clause("matched", "update", "s.v = 'zzz'"), Clause("matched", "delete"), Clause("not_matched", "insert", "s.v > 'd'", {"id": "s.id", "v": "upper(s.v)"}), Clause("not_matched_by_source", "update", "t.id IS NOT NULL", {"v": "'gone'"})]
    assert pairs(merge.merge(target, source, ["id"], how)) == sorted([(1, "gone"), (None, "n"), (3, "E"), (None, "M")], key=str)


def test_merge_of_several_matches_is_an_error(spark, target):
    twice = spark.createDataFrame([(2, "c"), (2, "d")], "id long, v string")
    with pytest.raises(Exception, match="matches several source rows"):
        merge.merge(target, twice, ["id"]).collect()
    assert merge.merge(target, twice, ["id"], merge.INSERT_ONLY).count() == 3
    assert pairs(merge.merge(target, twice.where("false"), ["id"])) == pairs(target) and merge.merge(target.where("false"), twice, ["id"]).count() == 2


def test_changes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert pairs(merge.changes(old, new, "id", ["v"])) == [(1, "delete", "a"), (2, "update_postimage", "c"), (2, "update_preimage", "b"), (3, "insert", "d")]


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    t.overwrite(rows((1, "a"), (2, "b")), DAY[0])
    t.merge(rows((2, "c"), (3, "d")), ["id"], DAY[1])
    t.append(spark.createDataFrame([(4, "e", 7)], "id long, v string, more int"), DAY[2])
    assert pairs(t.read(0)) == [(1, "a"), (2, "b")] and pairs(t.read(1)) == [(1, "a"), (2, "c"), (3, "d")]
    assert pairs(t.read().fillna(0)) == [(1, "a", 0), (2, "c", 0), (3, "d", 0), (4, "e", 7)]
    assert [r.change for r in t.changes("id", 0, 1).orderBy("id", "change").collect()] == ["update_postimage", "update_preimage", "insert"]
    assert {r.commit_version for r in t.changes("id", 0).collect()} == {1, 2}
    other = t.clone(f"file://{tmp_path}/u", DAY[3], version=1)
    other.append(rows((9, "z")), DAY[4])
    assert other.read().count() == 4 and t.read().count() == 4
    t.rename("v", "w", DAY[5])
    assert t.read().columns == ["id", "w", "more"] and pairs(t.read().select("w")) == [("a",), ("c",), ("d",), ("e",)] and t.read(1).columns == ["id", "v"]
    t.constrain("positive", "id > 0", DAY[6])
    t.constrain("positive", "id > 0", DAY[6])
    with pytest.raises(ValueError):
        t.constrain("small", "id < 3", DAY[6])
    with pytest.raises(Exception, match="constraint positive is violated"):
        t.append(spark.createDataFrame([(-1, "x", 1)], "id long, w string, more int"), DAY[7])
    t.cluster(["id"], DAY[8])
    before = t.read()
    t.compact(DAY[9])
    assert pairs(t.read()) == pairs(before) and len(t.entry()["folders"]) == 1
    t.describe(DAY[10], "numbers", {"id": "the key"}, {"owner": "me"})
    assert t.read().schema["id"].metadata == {"comment": "the key"}
    d = t.detail().first()
    assert (d.comment, d.cluster_by, d.constraints, d.properties) == ("numbers", ["id"], ["positive"], {"owner": "me"}) and d.bytes > 0
    assert [r.operation for r in t.history().orderBy("version").collect()] == ["overwrite", "merge", "append", "rename", "constrain", "cluster", "compact", "describe"]
    old = t.vacuum(DAY[9])
    assert len(old) == 3 and pairs(t.read(0)) == [(1, "a"), (2, "b")]
    t.restore(1, DAY[11])
    assert pairs(t.read()) == [(1, "a"), (2, "c"), (3, "d")]
    t.vacuum(DAY[12], dry_run=False)
    assert pairs(t.read()) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(LookupError):
        t.read(0)
    with pytest.raises(FileExistsError):  # a second writer of the same version
        t.files.write("log/00000008.json", "{}", replace=False)
    t.drop()
    assert not t.versions()


def test_ingest_of_json(spark, tmp_path):
    feed = landing.Feed(spark, f"{tmp_path}/in", f"file://{tmp_path}/out")
    (tmp_path / "in").mkdir()
    put = lambda name, *rows: (tmp_path / "in" / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    put("1.json", {"id": 1, "v": "a"}, {"id": 2, "v": "b"})
    assert feed.run() == 2 and feed.run() == 2
    put("2.json", {"id": "x", "v": "c", "more": 1.5}, {"id": 4}, "{broken")
    assert feed.run() == 5
    got = {r._source_file.rpartition("/")[2] + str(r.id): r for r in feed.read().collect()}
    assert got["2.json4"].more is None and got["1.json1"].more is None and got["1.json1"]._rescued_data is None and got["1.json1"]._batch_id == 0
    odd = sorted(r._rescued_data for r in feed.read().where("id IS NULL").collect())
    assert odd == ['{"id":"x"}', "{broken"] and feed.read().where("more = 1.5").count() == 1
    rescue = landing.Feed(spark, f"{tmp_path}/in", f"file://{tmp_path}/fixed", grow=False, files=1)
    assert rescue.run() == 5 and {*rescue.schema().names} in ({"id", "v"}, {"id", "v", "more"})


def test_ingest_of_csv_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,v\n1,a\n2,\n")
    feed = landing.Feed(spark, f"{tmp_path}/in", f"file://{tmp_path}/out", "csv")
    assert feed.run() == 2
    (tmp_path / "in" / "b.csv").write_text("v,id,more\nx,3,y\n")
    assert feed.run() == 3
    assert pairs(feed.read().select("id", "v", "more").fillna("-")) == [("1", "a", "-"), ("2", "-", "-"), ("3", "x", "y")]
    df = spark.range(10).coalesce(1)
    files.write_json(df, f"{tmp_path}/j", rows=3)
    files.write_csv(df, f"{tmp_path}/c")
    assert len([*(tmp_path / "j").glob("*.json")]) == 4 and landing.query_path(spark, "json", f"{tmp_path}/j").count() == 10
    files.append_merged(spark, df, f"{tmp_path}/m")
    assert pairs(files.append_merged(spark, df.withColumn("x", F.lit(1)), f"{tmp_path}/m").groupBy("x").count()) == [(1, 10), (None, 10)]


def test_synthetic_feed(spark, tmp_path):
    one, two, other = (synthetic.Feed(spark, s) for s in (7, 7, 8))
    people = one.customers(200, DAY[0])
    assert pairs(people) == pairs(two.customers(200, DAY[0])) and pairs(people) != pairs(other.customers(200, DAY[0]))
    moved = one.evolve(people, DAY[5])
    assert 0 < moved.count() < 200 and moved.join(people, "customer_id", "left_anti").count() == 0 and moved.where(f"updated_at <= '{DAY[0]}'").count() == 0
    goods = one.products(50, DAY[0])
    orders = one.orders(1000, people, DAY[1])
    assert orders.count() > orders.select("order_id").distinct().count() == 1000
    assert orders.where("customer_id IS NULL").count() and orders.where("status = 'odd'").count() and orders.where("order_ts > '2027'").count()
    lines = one.items(orders, goods)
    assert lines.join(orders, "order_id", "left_anti").count() == 0 and orders.join(lines, "order_id", "left_anti").count() == 0 and lines.where("quantity <= 0").count()
    assert lines.count() == lines.select("order_item_id").distinct().count()
    clicks = one.clicks(500, DAY[1])
    assert clicks.select("event_id").distinct().count() == 500 and clicks.groupBy("session_id").agg(F.countDistinct("device").alias("n")).where("n > 1").count() == 0
    synthetic.live(one, f"{tmp_path}/live", DAY[:3], rows=50)
    assert spark.read.json(f"{tmp_path}/live").count() == 150


CLICK = "event_id string, session_id string, event_ts timestamp, event_type string, product_id string, device string, is_conversion boolean"


def click(k, at, kind="product_view"):
    return {"event_id": str(k), "session_id": f"s{k % 3}", "event_ts": at, "event_type": kind, "product_id": "p", "device": "mobile", "is_conversion": kind == "checkout"}


def test_stream_drops_late_events_counts_once_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sink = sinks.Upserts(spark, f"file://{tmp_path}/out", ["window_start", "device"])
    seen = sinks.Progress()
    spark.streams.addListener(seen)

    def step(name, *events):
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, events)) + "\n")
        q = sinks.upsert(windows.windowed(landing.stream(spark, f"{tmp_path}/in", CLICK)), sink, f"{tmp_path}/ck", name="clicks")
        q.awaitTermination()
        return {r.window_start.strftime("%H:%M"): (r.events, r.checkouts) for r in sink.read().collect()}, sinks.late_rows(q)

    got, _ = step("1.json", click(1, "2026-01-01T10:01:00"), click(2, "2026-01-01T10:02:00", "checkout"), click(2, "2026-01-01T10:02:00", "checkout"), click(3, "2026-01-01T10:31:00"))
    assert got == {"10:00": (2, 1), "10:30": (1, 0)}
    got, late = step("2.json", click(4, "2026-01-01T10:21:00"), click(5, "2026-01-01T10:05:00"), click(3, "2026-01-01T10:31:00"))  # 10 and 26 minutes late, and a repeat
    assert got == {"10:00": (2, 1), "10:30": (1, 0), "10:20": (1, 0)} and late >= 1
    sink.write(sink.read(), 99)  # the same rows again change nothing
    assert {r.events for r in sink.read().collect()} == {2, 1}
    deadline = time.time() + 20
    while not seen.rows and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert any(r["name"] == "clicks" for r in seen.rows) and sinks.stop_all(spark) == []


def test_batch_windows_equal_hand_counts(spark):
    rows = [(*click(k, None).values(),) for k in (1, 2, 2)]
    df = spark.createDataFrame([(r[0], r[1], datetime(2026, 1, 1, 10, 1), *r[3:]) for r in rows], CLICK)
    r = windows.windowed(df, exact=True).first()
    assert (r.events, r.sessions, r.products, r.checkouts, r.conversion_rate) == (2, 2, 1, 0, 0.0)


def test_flows(spark, tmp_path):
    f = flows.Flows(spark, f"{tmp_path}/flows")
    src = spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "id long, v string")
    f.dataset("top", ("mid",))(lambda read: read("mid").agg(F.count("*").alias("n")))
    f.dataset("mid", ("view",), expect={"has_v": "v IS NOT NULL"}, drop={"has_id": "id IS NOT NULL"})(lambda read: read("view"))
    f.dataset("view", ("raw",), view=True)(lambda read: read("raw").withColumn("x", F.lit(1)))
    assert f.order() == ["view", "mid", "top"]
    f.run({"raw": src}, DAY[0])
    assert spark.read.parquet(f"{tmp_path}/flows/top").first().n == 2
    got = {(r.dataset, r.expectation): (r.passed, r.failed) for r in flows.expectation_metrics(f.events()).collect()}
    assert got == {("mid", "has_v"): (2, 1), ("mid", "has_id"): (2, 1)}
    assert {r.dataset: (r.rows_written, r.rows_dropped) for r in flows.flow_progress(f.events()).collect()} == {"mid": (2, 1), "top": (1, 0)}
    f.dataset("strict", ("raw",), fail={"has_id": "id IS NOT NULL"})(lambda read: read("raw"))
    with pytest.raises(Exception, match="expectation has_id failed"):
        f.run({"raw": src}, DAY[1])
    assert [r.dataset for r in flows.troubles(f.events()).collect()] == ["strict"]
    f.dataset("a", ("b",))(lambda read: read("b"))
    f.dataset("b", ("a",))(lambda read: read("a"))
    with pytest.raises(ValueError):
        f.order()


def test_policies(spark):
    rows = spark.createDataFrame([(1, "Ann", "a@x.de", "DE"), (2, "Bob", "b@y.fr", "FR"), (3, "Cid", None, None)], "id long, name string, mail string, country string")
    access = spark.createDataFrame([("eva", "DE"), ("g", "DE"), ("boss", "*")], "principal string, value string")
    p = policies.Policies()
    p.set_filter("t", "country")
    p.set_mask("t", "mail", "mask_email")
    assert pairs(p.view("t", rows, access, "eva", ["g"])) == [(1, "Ann", "***@x.de", "DE")]
    assert p.view("t", rows, access, "nobody", []).count() == 0 and p.view("t", rows, access, "boss", ["admins"]).where("mail = 'b@y.fr'").count() == 1 and p.view("t", rows, access, "boss", []).count() == 3
    assert p.bound(spark).count() == 2
    p.drop_filter("t")
    p.drop_mask("t", "mail")
    assert pairs(p.view("t", rows, access, "nobody", [])) == pairs(rows)
    p.tag("t", "mail", pii="yes")
    assert pairs(p.tagged(spark)) == [("t", "mail", "pii", "yes")]
    with pytest.raises(KeyError):
        p.set_mask("t", "mail", "none")


def test_prices_valid_at_the_time(spark):
    usage = spark.createDataFrame([("j", "s", date(2026, 1, 1), 2), ("j", "s", date(2026, 2, 1), 3), ("j", "t", date(2026, 1, 1), 9)], "job string, sku string, at date, quantity int")
    prices = spark.createDataFrame([("s", 1.0, date(2025, 1, 1), date(2026, 2, 1)), ("s", 2.0, date(2026, 2, 1), None)], "sku string, price double, valid_from date, valid_to date")
    r = policies.cost_per_job(usage, prices).collect()
    assert [(x.sku, x.units, float(x.cost)) for x in r] == [("s", 5, 8.0)]


def test_jobs():
    tries, order, gate = [], [], threading.Event()

    def flaky():
        tries.append(1)
        if len(tries) < 2:
            raise RuntimeError("once")
        return 7

    def bad():
        raise RuntimeError("always")

    job = Job("j", [
        Task("last", lambda: order.append("last"), ("one", "bad"), run_if="at_least_one_success"), Task("one", flaky, retries=1), Task("bad", bad), Task("never", lambda: order.append("never"), ("bad",)),
        Task("slow", lambda: gate.wait(5), timeout=0.05), Task("end", lambda: order.append("end"), ("never", "slow"), run_if="all_done")], alarm=0.0)
    got = job.run()
    gate.set()
    assert {k: v["state"] for k, v in got.items()} == {"one": "success", "bad": "failed", "never": "skipped", "last": "success", "slow": "timed_out", "end": "success", "_run": "failed"}
    assert got["one"]["attempts"] == 2 and got["one"]["value"] == 7 and sorted(order) == ["end", "last"] and got["_run"]["slow"]
    with pytest.raises(ValueError):
        Job("c", [Task("a", bad, ("b",)), Task("b", bad, ("a",))])
    held = Job("h", [Task("a", lambda: gate2.wait(5))])
    gate2 = threading.Event()
    t = threading.Thread(target=held.run)
    t.start()
    time.sleep(0.1)
    with pytest.raises(RuntimeError):
        held.run()
    gate2.set()
    t.join()


def test_settings(spark, monkeypatch):
    class Odd:
        class conf:  # noqa: N801
            @staticmethod
            def get(_):
                raise RuntimeError

    class Set:
        class conf:  # noqa: N801
            @staticmethod
            def get(_):
                return "from/conf"

    monkeypatch.delenv("QUARRY_ROOT", raising=False)
    assert Settings.find().root == "warehouse/dev" and Settings.find("x", Set).root == "x" and Settings.find(spark=Set).root == "from/conf" and Settings.find(spark=Odd).root == "warehouse/dev"
    monkeypatch.setenv("QUARRY_ROOT", "from/env")
    assert Settings.find(spark=Odd).root == "from/env" and Settings.of("prod").root == "warehouse/prod"
    s = Settings("r")
    assert (s.table("gold", "rfm"), s.landing("orders"), s.checkpoint("c")) == ("r/gold/rfm", "r/raw/orders", "r/_checkpoints/c")
    with pytest.raises(KeyError):
        s.table("gold", "nothing")
    assert session() is spark and scalar(spark.sql("SELECT 7")) == 7 and scalar(spark.range(0)) is None and not table_exists(spark, "no_table") and conf(spark, "no.key") is None
    assert can(spark, "SELECT 1") and not can(spark, "ALTER TABLE x SET ROW FILTER y")


def test_churn(spark, tmp_path):
    rows = [(f"c{k}", "DE" if k % 2 else "FR", "pro", *[float((k * (j + 3)) % 17) for j in range(len(churn.NUMERIC))], date(2026, 1, 1), int(k % 17 > 8)) for k in range(400)]
    schema = ", ".join(["customer_id string", "country string", "segment string", *(f"{c} double" for c in churn.NUMERIC), "as_of_date date", "churned int"])
    df = spark.createDataFrame(rows, schema)
    learn, test = churn.split(df)
    assert 250 < learn.count() < 330 and learn.join(test, "customer_id").count() == 0 and learn.count() + test.count() == 400
    registry = churn.Registry(spark, f"file://{tmp_path}/models")
    with pytest.raises(LookupError):
        registry.load()
    model, found, alias = churn.train(df, registry, DAY[0], iterations=3, depth=2)
    assert alias == "champion" and found["roc_auc"] > 0.9
    assert registry.register(model, {"roc_auc": found["roc_auc"]}, DAY[1]) == "challenger" and registry.champion()[0] == 1
    assert registry.register(model, {"roc_auc": 1.1}, DAY[2]) == "champion"
    version, loaded = registry.load()
    scores = churn.score(loaded, version, df, DAY[3])
    assert version == 3 and scores.count() == 400 and {r.risk_band for r in scores.collect()} <= {"low", "medium", "high"}
    top = churn.importance(model, df.limit(200), top=3)
    assert len(top) == 3 and top[0][1] >= top[-1][1]
    assert churn.drift(scores, "r").first().customers == 400
