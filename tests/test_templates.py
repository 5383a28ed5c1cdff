"""Template mining against a plain leader search, whatever the bound of a task."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logloom.operators import templates as T

START = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    """Rows (service, second, body)."""
    return spark.createDataFrame([(i, "org-1", s, START + dt.timedelta(seconds=at) if at is not None else None, 2, m) for i, (s, at, m) in enumerate(rows)],
                                 "id long, tenant_id string, service_name string, timestamp_utc timestamp, severity int, body_raw string")


def plain(rows, sim_th=0.4):
    """service, template of every row that is not blank, by one pass over the shapes in order."""
    first = {}
    for s, at, m in rows:
        text = " ".join("<*>" if any(c.isdigit() for c in t) else t for t in m.split())
        key = (s, text)
        first[key] = min(first.get(key, 1 << 60), at)
    leaders, member, kept = {}, {}, {}
    for (s, text), at in sorted(first.items(), key=lambda x: (x[1], x[0][1])):
        tokens = text.split(" ")
        group = leaders.setdefault((s, len(tokens), tokens[0]), [])
        scored = [(sum(a == b != "<*>" for a, b in zip(tokens, g)), g.count("<*>"), -i) for i, g in enumerate(group)]
        best = max(scored, default=None)
        if best and best[0] >= sim_th * len(tokens):
            at_leader = (s, len(tokens), tokens[0], -best[2])
        else:
            group.append(tokens)
            at_leader = (s, len(tokens), tokens[0], len(group) - 1)
        member[s, text] = at_leader
        old = kept.get(at_leader, tokens)
        kept[at_leader] = [a if a == b else "<*>" for a, b in zip(old, tokens)]
    return {k: " ".join(kept[v]) for k, v in member.items()}


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{c}" for c in "abcdefgh"]
    return [(rng.choice(["api", "db"]), rng.randint(0, 200), " ".join(["go", *[rng.choice(words + ["7"]) for _ in range(rng.choice([3, 6]))]])) for _ in range(n)]


@pytest.mark.parametrize("limit", [1000, 7])
def test_templates_equal_the_plain_search(spark, limit):
    rows = made(1)
    want = plain(rows)
    got = T.mine_templates(frame(spark, rows), group_limit=limit).withColumn("shape", T.masked_text(T.spaced_text(F.col("body_raw"))))
    found = {(r["service_name"], r["shape"]): r["template_text"] for r in got.collect()}
    assert found == want and len(set(want.values())) > 5


def test_every_row_keeps_its_place_and_odd_rows_are_defined(spark):
    rows = [("api", 1, "User alice logged in"), ("api", None, "User bob logged in"), (None, 3, "User bob logged in"), ("api", 4, ""), ("api", 5, None),
            ("api", 6, "1 2 3"), ("api", 6, "1 2 3"), ("api", 7, "x " * 3000), ("api", 8, "x " * 2999 + "y")]
    out = T.mine_templates(frame(spark, rows), group_limit=1).orderBy("id").collect()
    assert [r["template_text"] for r in out[:7]] == ["User <*> logged in", "User <*> logged in", "User bob logged in", "<*>", "<*>", "<*> <*> <*>", "<*> <*> <*>"]
    assert out[7]["template_text"] == out[8]["template_text"] == "x " * 2999 + "<*>"
    assert out[5]["parameters"] == ["1", "2", "3"] and len(out) == len(rows)
    assert T.mine_templates(frame(spark, [])).collect() == []


def test_a_token_that_all_shapes_share_makes_no_pairs_on_its_own(spark):
    """200 leaders that share their first token only: no candidate pair is left to compare."""
    shapes = T.grouped(spark.createDataFrame([("api", f"go a{chr(97 + i % 26)}{chr(97 + i // 26)} b c".replace(" b c", f" b{chr(97 + i % 26)}{chr(97 + i // 26)} c{chr(97 + i % 26)}{chr(97 + i // 26)}"))
                                              for i in range(200)], "service_name string, text string"), 4).withColumn("at", F.lit(0))
    assert T.similar_pairs(shapes, shapes, 0.4).count() == 0
    assert T.find_leaders(shapes, 0.4, 50).count() == 200
