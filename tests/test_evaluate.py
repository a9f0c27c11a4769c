import hashlib
import random

import pytest

from tallywise.operators import evaluate as ev
from tallywise.operators import ledger


@pytest.mark.parametrize("n", [1, 3, 25])
def test_bootstrap_draws_all_clusters(spark, n):
    r = random.Random(n)
    rows = [(f"c{k:02}", r.random() < 0.2 + 0.03 * k) for k in range(n) for _ in range(r.randint(1, 9))]
    own = [[s for c, s in rows if c == f"c{k:02}"] for k in range(n)]
    shares = []
    for i in range(200):
        drawn = [own[int(hashlib.md5(f"{i}:{k}".encode()).hexdigest()[:12], 16) % n] for k in range(n)]
        shares.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
    shares.sort()
    got = ev.bootstrap(spark.createDataFrame(rows, "cell string, strict boolean"), "cell", times=200).collect()
    assert [tuple(x) for x in got] == [(pytest.approx(shares[5]), pytest.approx(shares[194]))]


def test_upper_medians_gather_no_group(spark):
    r = random.Random(8)
    rows = [(k, None if r.random() < 0.1 else float(r.randint(-5, 5) if k == "a" else r.randint(0, 10**6))) for k in ["a", "b", None, *"abc" * 500]] + [("empty", None)]
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(v for x, v in rows if x == k and v is not None)
        if own:
            want[k] = own[len(own) // 2]
    got = ev.upper_medians(spark.createDataFrame(rows, "kind string, value double"), "kind", "value")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {x.kind: x.median for x in got.collect()} == want


def test_admission_streams_a_large_ledger(spark):
    r = random.Random(9)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), k, r.choice([None, 0.5, 1.0, 7.0])) for k in range(40_000)]
    used, want = {}, {}
    for k, seq, usd in rows:
        want[seq] = None if usd is None else used.get(k, 0.0) + usd <= 9000.0
        used[k] = used.get(k, 0.0) + (usd if want[seq] else 0.0)
    r.shuffle(rows)
    got = ledger.admitted(spark.createDataFrame(rows, "ledger string, seq long, usd double"), 9000.0)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {x.seq: x.ok for x in got.collect()} == want
