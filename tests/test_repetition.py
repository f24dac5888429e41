"""The repetition log against its rule restated, as a table, as a stream with list state, and forked from a checkpoint."""

import random

import pytest

from skein.operators.sequences import numbered
from skein.streaming import repetition


@pytest.fixture
def list_state(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, repetition.PROVIDER)
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def rows_of(seed, count=160, letters="abcde"):
    rng = random.Random(seed)
    return [(i, rng.choice(["p", "q", None]), i + 1, sorted(rng.sample(letters, rng.randrange(0, 4)))) for i in range(count)]


def restated(rows, keep=8, half_life=64.0, floor=0.02):
    """id -> (nearest, weight, cost, hits, medoids), and the logs, by the rule as written."""
    logs, out = {}, {}
    for i, bucket, seq, items in sorted(rows, key=lambda r: r[2]):
        log, items = logs.setdefault(bucket, []), frozenset(items or ())
        weight = lambda m, now: m["w"] * 0.5 ** ((now - m["at"]) / half_life)
        away = lambda m: 1 - len(items & m["x"]) / len(items | m["x"]) if items | m["x"] else 0.0
        live = [m for m in log if weight(m, seq - 1) >= floor]
        near = min(live, key=away) if live else None
        score = (away(near), weight(near, seq - 1), min(1.0, max(0.0, weight(near, seq - 1) * (1 - away(near))))) if near else (None, None, 0.0)
        same = next((m for m in log if m["x"] == items), None)
        if same:
            same.update(w=weight(same, seq) + 1, at=seq, n=same["n"] + 1)
        else:
            same = {"x": items, "w": 1.0, "at": seq, "n": 1}
            log.append(same)
            if len(log) > keep:
                log.sort(key=lambda m: (weight(m, seq), m["at"]))
                del log[0]
        out[i] = (*score, same["n"], len(log))
    return out, {b: [(sorted(m["x"]), m["w"], m["at"], m["n"]) for m in log] for b, log in logs.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, bucket string, seq long, items array<string>")


def scores(found):
    return {r.id: pytest.approx((r.nearest, r.weight, r.cost, r.hits, r.medoids)) for r in found}


def logs(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.place):
        out.setdefault(r.bucket, []).append((r["items"], pytest.approx(r.weight), r.last_seen, r.hits))
    return out


@pytest.mark.parametrize("options", [{}, {"keep": 2}, {"half_life": 3.0, "floor": 0.3}, {"half_life": 0.0}])
def test_replay_and_log_follow_the_rule(spark, options):
    rows = rows_of(5)
    if options.get("half_life") == 0.0:
        want, log = restated(rows, half_life=1e18)
    else:
        want, log = restated(rows, **options)
    df = frame(spark, rows).repartition(3)
    assert {k: v for k, v in scores(repetition.replay(df, **options).collect()).items()} == want
    assert logs(repetition.medoids(df, **options)) == log
    assert any(v[3] > 1 for v in want.values())


def test_a_log_can_be_started_from_and_swept(spark):
    rows = rows_of(8)
    want, log = restated(rows)
    half = repetition.medoids(frame(spark, rows[:80]))
    assert scores(repetition.replay(frame(spark, rows[80:]), start=half).collect()) == {k: v for k, v in want.items() if k >= 80}
    assert logs(repetition.medoids(frame(spark, rows[80:]), start=half)) == log
    kept = repetition.swept(repetition.medoids(frame(spark, rows)), now=520).count()
    assert kept == sum(w * 0.5 ** ((520 - at) / 64) >= 0.02 for own in log.values() for _, w, at, _ in own) and 0 < kept < sum(map(len, log.values()))


def streamed(spark, folder, rows, checkpoint, start=None):
    """Results of a stream that takes one file of rows a batch."""
    for n in range(0, len(rows), 40):
        frame(spark, rows[n : n + 40]).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema("id long, bucket string, seq long, items array<string>").option("maxFilesPerTrigger", 1).parquet(folder)
    name = "scores_" + checkpoint.rsplit("/", 1)[-1]
    run = repetition.score_stream(source, start=start).writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).collect()


def test_stream_equals_table_and_its_state_can_be_forked(spark, tmp_path, list_state):
    rows = [(i, b or "r", s, x) for i, b, s, x in rows_of(9)]
    want, log = restated(rows)
    assert scores(streamed(spark, f"{tmp_path}/in", rows[:80], f"{tmp_path}/one")) == {k: v for k, v in want.items() if k < 80}
    fork = repetition.forked(spark, f"{tmp_path}/one")
    assert logs(fork) == restated(rows[:80])[1]
    # the copy starts another stream and a table run; the original stays as it was
    assert scores(streamed(spark, f"{tmp_path}/in2", rows[80:], f"{tmp_path}/two", start=fork)) == {k: v for k, v in want.items() if k >= 80}
    assert logs(repetition.medoids(frame(spark, rows[80:]), start=fork)) == log
    assert logs(repetition.forked(spark, f"{tmp_path}/one")) == restated(rows[:80])[1]


def test_rows_are_numbered_across_ranges(spark):
    rng = random.Random(2)
    values = [(rng.randrange(300), i) for i in range(1000)] + [(None, 5000)]
    got = {r.i: r.seq for r in numbered(spark.createDataFrame(values, "v int, i int"), "v", ["i"], rows=90).collect()}
    order = sorted(values, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert got == {i: n for n, (_, i) in enumerate(order, 1)}
    assert numbered(spark.createDataFrame([], "v int"), "v").count() == 0


def test_documents_are_numbered_in_small_ranges_and_without_their_words(spark, sf, monkeypatch):
    from skein import queries

    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    monkeypatch.setattr(queries, "UTTERANCES", 30)
    rows = queries.utterances(t)
    ids = sorted(r.doc_id for r in t("documents").select("doc_id").collect())
    assert {r.id: r.seq for r in rows.select("id", "seq").collect()} == {d: n for n, d in enumerate(ids, 1)}
    sizes = [r["count"] for r in rows.groupBy(((rows.seq - 1) / 30).cast("int")).count().collect()]
    assert max(sizes) == 30
    window = next(x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in x)
    assert "digest" in window and "items" not in window.split("windowspecdefinition")[1]
