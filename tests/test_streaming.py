import datetime as dt
import random

import pytest

from tallywise.operators import ledger as batch
from tallywise.operators import verify
from tallywise.streaming import answers, ledger

EVENT = "ledger string, id long, seq long, kind string, usd double, t timestamp"
AT = dt.datetime(2024, 1, 1)


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ledger.PROVIDER)
    yield
    spark.conf.set(name, before)


def arrive(spark, parts, kind, tmp_path, run):
    """Each part is one micro-batch of a stream that stops in between and goes on from its checkpoint."""
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "progress")).awaitTermination()


def test_balances_are_those_of_the_batch(spark, tmp_path, state_store):
    r = random.Random(2)
    rows = []
    for i in range(60):
        own, usd = r.choice("aaab"), r.choice([1.0, 2.5, 7.0])
        rows.append([own, i, "reserve", usd])
        if r.random() < 0.7:
            rows.append([own, i, "settle", r.choice([None, 0.0, usd, usd - 0.5, usd + 3])])
        if r.random() < 0.2:
            rows.append([own, i, "reserve", 4.0])
    events = [(*x[:2], k, *x[2:], AT + dt.timedelta(minutes=k)) for k, x in enumerate(rows)]
    r.shuffle(events)
    parts = [events[:30], events[30:31], [(*events[31][:5], AT)] + events[32:90], events[90:]]
    arrive(spark, parts, EVENT, tmp_path, lambda s, state: ledger.balances(s, str(tmp_path / "out"), state, "10 days", 3))
    want = batch.balance(spark.createDataFrame([x for p in parts for x in p], EVENT), 0.0)
    plain = lambda df: {x.ledger: (round(x.spent, 6), round(x.reserved, 6)) for x in df.collect()}
    assert plain(ledger.latest(spark, str(tmp_path / "out"))) == plain(want)


def test_a_settlement_drops_what_was_reserved(spark, tmp_path, state_store):
    parts = [[("a", 1, 1, "reserve", 5.0, AT), ("a", 2, 2, "reserve", 1.0, AT)], [("a", 1, 3, "settle", 3.0, AT)], [("a", 1, 0, "reserve", 9.0, AT)]]
    arrive(spark, parts, EVENT, tmp_path, lambda s, state: ledger.balances(s, str(tmp_path / "out"), state, "1 day", 1))
    assert [tuple(x) for x in ledger.latest(spark, str(tmp_path / "out")).select("ledger", "spent", "reserved").collect()] == [("a", 3.0, 1.0)]


def test_every_event_has_one_verdict(spark, tmp_path):
    t = lambda minutes: AT + dt.timedelta(minutes=minutes)
    parts = [
        [("a", 1, 1, "reserve", 1.0, t(0)), ("a", 1, 2, "reserve", 1.0, t(1)), ("a", 1, 3, "settle", 1.0, t(100)), ("b", 1, 4, "reserve", 1.0, None)],
        [("a", 2, 5, "reserve", 1.0, t(39)), ("a", 2, 6, "reserve", 1.0, t(41)), ("a", 1, 7, "settle", 1.0, t(101)), ("b", 1, 8, "reserve", 1.0, t(100)), ("a", 3, 9, "reserve", 1.0, t(300))],
        [("a", 3, 10, "reserve", 1.0, t(241)), ("a", 1, 11, "settle", 2.0, t(250)), ("a", 4, 12, "settle", 2.0, t(239))],
        [],
    ]
    arrive(spark, parts, EVENT, tmp_path, lambda s, state: ledger.clean_and_late(s, str(tmp_path / "out"), state, "60 minutes"))
    got = {x.seq: x.verdict for x in ledger.verdicts(spark, str(tmp_path / "out")).collect()}
    late, again = {5, 12}, {2, 7, 8, 10}
    assert got == {k: "late" if k in late else "repeated" if k in again else "clean" for k in range(1, 13)}


def test_an_event_repeated_very_often_is_found_once(spark, tmp_path):
    rows = [("a", 1, k, "reserve", 1.0, AT + dt.timedelta(seconds=k % 7)) for k in range(500)]
    arrive(spark, [rows], EVENT, tmp_path, lambda s, state: ledger.clean_and_late(s, str(tmp_path / "out"), state))
    assert [x.seq for x in ledger.verdicts(spark, str(tmp_path / "out")).where("verdict = 'clean'").collect()] == [0]


def test_claims_verified_as_they_arrive_are_those_of_one_batch(spark, tmp_path):
    kind = "doc_id string, seq int, field string, period_type string, period_start string, period_end string, doc_end date, page int, quote string, raw_value string, raw_unit string, raw_currency string, market string"
    end, r, rows = dt.date(2024, 12, 31), random.Random(6), []
    for d in range(5):
        for k in range(8):
            field = r.choice(["revenue", "eps_basic", "cost"])
            rows.append((f"d{d}", k, field, "FY", None, r.choice(["2024-12-31", "2024-12-31", "2023-12-31"]), end, 1, f"Item {k % 3}", r.choice(["100", "200"]), "per share" if field == "eps_basic" else "in thousands", "HKD", "hk"))
    pages = verify.prepared_pages(spark.createDataFrame([(f"d{d}", 1, "Item 0 100, Item 1 200, Item 2") for d in range(5)], "doc_id string, page int, text string"))
    facts = spark.createDataFrame([(f"d{d}", 1, f, "FY", end, v, "HKD") for d in range(5) for f, v in (("revenue", 100_000.0), ("eps_basic", 100.0 if d % 2 else 55.0))], "doc_id string, ord long, field string, period_type string, period_end date, value double, currency string")
    r.shuffle(rows)
    cut = [rows[:11], rows[11:12], rows[12:]]
    arrive(spark, cut, kind, tmp_path, lambda s, state: answers.verify_arriving(s, pages, facts, str(tmp_path / "out"), state))
    cols = ["doc_id", "seq", "field", "period_type", "c1", "c2", "c3", "state", "status", "category", "ref_value"]
    plain = lambda df: sorted(map(str, df.select(cols).collect()))
    want = plain(verify.verify(spark.createDataFrame(rows, kind), pages, facts))
    assert plain(answers.current(spark, str(tmp_path / "out"))) == want and any("invalid" in x for x in want)
