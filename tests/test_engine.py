"""Labels, samplers, index and metrics on hand-made logs."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from hindcast.functions.columns import slug
from hindcast.functions.seeds import derive_seed
from hindcast.operators import asof, events as ev, label as lb, metrics as mt, preprocess as pp, sampling as sp, sequences as sq
from hindcast.plans import evaluation, external, predict, preprocess, training
from hindcast.schemas import DEATH, EVENT_LOG, INDEX, METRICS, PREDICTION, TASK_QUERY, SchemaError, align
from hindcast.sources import files, logs

BASE = datetime(2020, 1, 1)


def day(d):
    return BASE + timedelta(days=d)


def log(spark, rows):
    return spark.createDataFrame([(s, day(d), c) for s, d, c in rows], "subject_id long, time timestamp_ntz, code string")


def index(spark, rows):
    return spark.createDataFrame([(s, day(d), q, float(w)) for s, d, q, w in rows], "subject_id long, prediction_time timestamp_ntz, query string, duration_days float")


US = 1 / 86_400_000_000
# (events of subject 1 as (day, code), prediction day, code, window, label)
TRUTH = [
    ([(3, "A"), (100, "A")], 0, "A", 7, True),
    ([(3, "A")], 0, "A", 30, True),
    ([(10, "B")], 0, "A", 30, None),
    ([(100, "A")], 0, "A", 7, False),
    ([(0, "A"), (1, "A"), (2, "A"), (3, "A"), (367, "A")], 2, "A", 10, True),
    ([(0, "A"), (1, "A"), (2, "A"), (3, "A"), (367, "A")], 2, "A", 0, False),
    ([(0, "B"), (10, "A"), (100, "B")], 0, "A", 10, True),
    ([(0, "B"), (10 + US, "A"), (100, "B")], 0, "A", 10, False),
    ([(0, "A"), (100, "A")], 5, "A", 7, False),
    ([(6, "B"), (100, "A")], 5, "A", 7, False),
    ([(6, "B"), (100, "A")], 5, "B", 7, True),
    ([(6, "A"), (8, "A"), (100, "A")], 5, "A", 7, True),
    ([(3, "B"), (10, DEATH)], 0, "A", 30, None),
    ([(3, "C"), (10, DEATH), (20, "A")], 0, "A", 30, None),
    ([(3, "C"), (10, DEATH), (20, "A")], 0, "B", 5, False),
    ([(3, "B"), (10, DEATH)], 0, DEATH, 30, True),
    ([(10, DEATH), (15, "A"), (20, DEATH)], 0, "A", 30, None),
    ([(0, "A"), (1.25, "A"), (100, "Z")], 0, "A", 1.5, True),
    ([(0, "A"), (1.25, "A"), (100, "Z")], 0, "A", 1.0, False),
]


def test_truth_table(spark):
    rows = [(i, d, c) for i, (events, *_) in enumerate(TRUTH) for d, c in events]
    asked = index(spark, [(i, d, q, w) for i, (_, d, q, w, _) in enumerate(TRUTH)])
    got = {r.subject_id: r.boolean_value for r in lb.label_index(asked, log(spark, rows)).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(TRUTH)}


def test_unknown_subject_raises(spark):
    with pytest.raises(Exception, match="without events"):
        lb.label_index(index(spark, [(2, 0, "A", 1)]), log(spark, [(1, 0, "A")])).collect()


def test_labels_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(s), round(float(d), 2), str(c)) for s, d, c in zip(rng.integers(0, 12, 400), rng.integers(0, 4000, 400) / 100, rng.choice(["A", "B", "C", DEATH], 400, p=[0.4, 0.3, 0.28, 0.02]), strict=True)]
    asked = [(s, d, q, w) for s, d, _ in rows for q in "AB" for w in (0.5, 3.0, 20.25)]

    def want(s, d, q, w):
        own = [(x, c) for y, x, c in rows if y == s]
        dead = min((x for x, c in own if c == DEATH), default=None)
        own = [(day(x), c) for x, c in own if dead is None or x <= dead]
        end = day(d) + timedelta(days=w)
        if any(c == q and day(d) < x <= end for x, c in own):
            return True
        return None if end > max(x for x, _ in own) else False

    found = lb.label_index(index(spark, asked).distinct(), log(spark, rows).repartition(7)).collect()
    assert len(found) == len(set(asked))
    for r in found:
        d = (r.prediction_time - BASE) / timedelta(days=1)
        assert r.boolean_value == want(r.subject_id, round(d, 2), r.query, r.duration_days)


def test_asof_previous(spark):
    events = log(spark, [(1, 1, "A"), (1, 3, "A")]).withColumnRenamed("code", "query")
    asked = index(spark, [(1, d, "A", 1) for d in (0, 1, 2, 3, 9)])
    for strict, want in ((False, [None, 1, 1, 3, 3]), (True, [None, None, 1, 1, 3])):
        found = asof.previous_event(asked, events, ["subject_id", "query"], strict=strict).orderBy("prediction_time").collect()
        assert [r.previous_time for r in found] == [w and day(w) for w in want]


def test_prediction_times_and_counts(spark):
    rows = [(1, d, c) for d in range(5) for c in "AB"] + [(2, d, "A") for d in range(3)] + [(3, d, "A") for d in range(2)]
    times = ev.prediction_times(log(spark, rows))
    assert [(r.prediction_time_index, r.time) for r in times.where("subject_id = 1").orderBy("time").collect()] == [(i, day(i)) for i in range(5)]
    counts = ev.time_counts(times, 2)
    assert {(r.subject_id, r.n_prediction_times) for r in counts.collect()} == {(1, 5), (2, 3)}
    assert ev.eligible_times(times, counts).count() == 8
    static = spark.createDataFrame([(1, None, "DEMO//SEX")], "subject_id long, time timestamp_ntz, code string")
    assert ev.prediction_times(log(spark, rows).union(static)).count() == times.count()
    dead = log(spark, [(1, d, "A") for d in range(5)] + [(1, 2, DEATH), (2, 1, DEATH), *[(2, d, "A") for d in range(3)]])
    assert ev.prediction_times(ev.truncate_at_terminal(dead)).groupBy("subject_id").count().orderBy("subject_id").collect() == [(1, 3), (2, 2)]


SYNTHETIC = ["ICD//A01", "ICD//B02", "ICD//C03", "MED//D04", "MED//E05"]
SNAPSHOT = {
    (1, "2020-02-21", "ICD//B02", 1.145217776298523, False), (1, "2020-05-11", "ICD//A01", 38.73188018798828, True), (1, "2020-06-30", "MED//D04", 1.6647769212722778, False),
    (2, "2020-03-03", "MED//D04", 1.6647769212722778, False), (2, "2020-06-11", "ICD//A01", 38.73188018798828, False), (3, "2020-05-23", "ICD//B02", 1.145217776298523, False),
}


@pytest.fixture(scope="module")
def data_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("log")
    rows = [(s, 10 * i + s, SYNTHETIC[i % 5]) for s in (1, 2, 3) for i in range(30)]
    for shard, subjects in (("0", (1, 2)), ("1", (3,))):
        log(spark, [r for r in rows if r[0] in subjects]).toPandas().to_parquet(root / f"{shard}.parquet", coerce_timestamps="us")
    target = root / "data" / "train"
    target.mkdir(parents=True)
    for shard in "01":
        (root / f"{shard}.parquet").rename(target / f"{shard}.parquet")
    return str(root)


def config(data_dir, out, **more):
    return training.TrainingConfig(data_dir, str(out), SYNTHETIC, n_queries=3, contexts_per_query=2, least_times=5, **more)


def test_training_snapshot_and_restart(spark, data_dir, tmp_path):
    cfg = config(data_dir, tmp_path / "tasks")
    found = training.run(spark, cfg)
    assert (found["n_rows"], found["n_true"], found["n_false"]) == (6, 1, 5)
    table = spark.read.parquet(f"{cfg.output_dir}/train")
    got = {(r.subject_id, str(r.prediction_time.date()), r.query, r.duration_days, r.boolean_value) for r in table.collect()}
    assert got == SNAPSHOT
    assert training.cache_valid(spark, cfg)
    assert not training.cache_valid(spark, config(data_dir, tmp_path / "tasks", terminal="X"))
    assert training.run(spark, cfg) == found
    other = training.run(spark, config(data_dir, tmp_path / "tasks", seed=2))
    assert other["n_rows"] == 6
    by_row = training.run(spark, config(data_dir, tmp_path / "rows", by_row=True))
    assert by_row["n_rows"] == 6


def test_spanning_subject_raises(spark, tmp_path):
    target = tmp_path / "data" / "train"
    target.mkdir(parents=True)
    for shard in "01":
        log(spark, [(1, 0, "A")]).toPandas().to_parquet(target / f"{shard}.parquet", coerce_timestamps="us")
    with pytest.raises(ValueError, match="several shards"):
        training.build_prediction_times(spark, config(str(tmp_path), tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        logs.shard_names(spark, str(tmp_path), "none")


def test_seeds_and_draws(spark):
    assert (derive_seed(1, "queries"), derive_seed(1, "contexts")) == (1927230479, 1600026988)
    law = sp.QueryDistribution(("a", "b", "c"), 1, 365)
    many = law.sample(4000, np.random.default_rng(0))
    assert {q.code for q in many} == {"a", "b", "c"} and 12 < np.median([q.duration_days for q in many]) < 30
    assert law.sample(0, np.random.default_rng(0)) == []
    for bad in ({"codes": ()}, {"law": "normal"}, {"shortest": 0.0}, {"shortest": 9.0, "longest": 1.0}):
        with pytest.raises(ValueError):
            sp.QueryDistribution(**{"codes": ("a",)} | bad)
    with pytest.raises(ValueError):
        law.sample(-1, np.random.default_rng(0))
    rows = law.sample_rows(spark, 3000, 5).toPandas()
    assert set(rows["query"]) == {"a", "b", "c"} and rows.duration_days.between(1, 365).all() and 12 < rows.duration_days.median() < 30
    counts = spark.createDataFrame([(10, "0", 60), (20, "0", 51), (30, "0", 200), (40, "1", 80), (50, "1", 120)], "subject_id long, shard string, n_prediction_times long")
    for drawn in (sp.sample_contexts(counts, 2000, 50, np.random.default_rng(1)), sp.sample_contexts_by_row(counts, 2000, 50, 1)):
        got = drawn.join(counts.drop("shard"), "subject_id").toPandas()
        assert len(got) == 2000 and set(got.subject_id) == {10, 20, 30, 40, 50}
        assert (got.prediction_time_index >= 50).all() and (got.prediction_time_index < got.n_prediction_times).all()
    with pytest.raises(ValueError):
        sp.sample_contexts(counts, 5, 60, np.random.default_rng(1))
    with pytest.raises(ValueError):
        sp.sample_contexts(counts.limit(0), 5, 1, np.random.default_rng(1))


def test_evaluation_sampling(spark):
    events = log(spark, [(s, d, "A") for s in range(60) for d in range(10)])
    found = ev.sample_times(events, 3, 5, 1)
    assert {r["count"] for r in found.groupBy("subject_id").count().collect()} == {3}
    assert found.agg({"prediction_time": "min"}).first()[0] >= day(4)
    assert sorted(found.collect()) == sorted(ev.sample_times(events.repartition(5), 3, 5, 1).collect()) != sorted(ev.sample_times(events, 3, 5, 2).collect())
    assert ev.sample_times(events, 0, 5, 1).count() == 0 and ev.sample_times(events, 99, 5, 1).count() == 360
    with pytest.raises(ValueError):
        ev.sample_times(events, -1, 5, 1)
    assert 5 < ev.subsample_subjects(events, 0.3, 1).select("subject_id").distinct().count() < 32
    for bad, error in ((True, TypeError), ("x", TypeError), (0.0, ValueError), (1.5, ValueError), (float("nan"), ValueError), (float("inf"), ValueError)):
        with pytest.raises(error):
            ev.subsample_subjects(events, bad, 1)
    assert ev.subsample_subjects(events, None, 1) is events
    tied = log(spark, [(1, 0, "A"), (1, 1, "A"), (1, 1, "B")])
    assert [r.prediction_time for r in ev.candidate_times(tied, 3).collect()] == [day(1)]
    with pytest.raises(ValueError):
        ev.dense_grid(found, [], [1.0])
    with pytest.raises(ValueError):
        evaluation.whole_days([1.5])


def test_evaluation_run(spark, data_dir, tmp_path):
    out = evaluation.run_tasks(spark, data_dir, str(tmp_path), "train", SYNTHETIC[:2], [30, 60], 2, 5)
    tasks = spark.read.parquet(out)
    assert sorted(logs.read_tasks(spark, out).collect()) == sorted(tasks.drop("shard").collect())  # what prediction reads
    assert tasks.columns == [*TASK_QUERY.columns, "shard"] and tasks.where("boolean_value is null").count() == 0 and tasks.count() > 0
    assert evaluation.run_tasks(spark, data_dir, str(tmp_path), "train", SYNTHETIC[:2], [30, 60], 2, 5) is None
    # a shard that is missing is made again, alike, and the others are left alone
    rows = lambda: sorted(map(tuple, spark.read.parquet(out).collect()), key=str)
    before, shards = rows(), sorted(n for n, _ in files.entries(spark, out) if n.startswith("shard="))
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "train" / shards[-1]).iterdir()}
    files.delete(spark, f"{out}/{shards[0]}")
    assert evaluation.run_tasks(spark, data_dir, str(tmp_path), "train", SYNTHETIC[:2], [30, 60], 2, 5) == out
    assert rows() == before and len(shards) > 1 and {p: p.stat().st_mtime_ns for p in kept} == kept


def predictions(spark, rows):
    return spark.createDataFrame([(1, BASE, y, q, 30.0, c, o) for q, y, o, c in rows], PREDICTION.struct())


def test_metrics(spark):
    rows = [("A", True, 0.9, 0.05), ("A", False, 0.1, 0.1), ("A", None, 0.5, 0.9), ("B", True, 0.8, 0.02), ("B", True, 0.7, 0.08), ("B", None, 0.5, 0.8)]
    found = {r.query: r for r in mt.compute_metrics(predictions(spark, rows)).collect()}
    assert (found["A"].occurs_auroc, found["A"].censor_auroc, found["A"].prevalence, found["A"].n_rows) == (1.0, 1.0, 0.5, 3)
    assert (found["B"].occurs_auroc, found["B"].censor_auroc, found["B"].prevalence, found["B"].n_positive) == (None, 1.0, 1.0, 2)
    empty = mt.compute_metrics(PREDICTION.empty(spark))
    assert empty.count() == 0 and dict(empty.dtypes) == dict(METRICS.empty(spark).dtypes)
    rng = np.random.default_rng(2)
    y, s = rng.random(300) < 0.4, rng.integers(0, 12, 300)
    brute = np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in s[y] for b in s[~y]])
    frame = spark.createDataFrame([("g", bool(a), float(b)) for a, b in zip(y, s, strict=True)], "g string, y boolean, s double")
    assert mt.auroc_by(frame, ["g"], frame.y, frame.s, "auc").first().auc == pytest.approx(brute)
    with pytest.raises(ValueError, match="lack"):
        mt.compute_metrics(predictions(spark, rows).drop("censor_prob"))


def test_composites(spark):
    rows = [(1, BASE, "A", 0.5), (1, BASE, "B", 0.25), (2, BASE, "A", 1.0), (3, BASE, "A", 0.0)]
    probs = spark.createDataFrame(rows, "subject_id long, prediction_time timestamp_ntz, query string, occurs_prob double")
    got = {r.subject_id: (r.prob_max, r.prob_or, r.prob_sum) for r in mt.composite_probabilities(probs).collect()}
    assert got == {1: (0.5, 0.625, 0.75), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0)}
    with pytest.raises(ValueError, match="unknown"):
        mt.composite_probabilities(probs, ["mean"])
    labels = spark.createDataFrame([(1, BASE, True), (2, BASE, True), (3, BASE, False)], "subject_id long, prediction_time timestamp_ntz, boolean_value boolean")
    assert {r.auroc for r in mt.composite_auroc(probs, labels).collect()} == {1.0}
    assert all(np.isnan(r.auroc) for r in mt.composite_auroc(probs, labels.where("boolean_value")).collect())


def test_external_tasks(spark, tmp_path):
    wide = spark.createDataFrame([(1, BASE, True, True, False), (2, BASE, False, True, False)], "subject_id long, prediction_time timestamp_ntz, censored boolean, `A//1` boolean, B boolean")
    labels = spark.createDataFrame([(1, BASE, True), (2, BASE, False)], "subject_id long, prediction_time timestamp_ntz, boolean_value boolean")
    tasks = external.per_code_tasks(wide, labels, ["A//1", "B"], 30.0)
    got = {(r.subject_id, r.query): r.boolean_value for r in tasks.collect()}
    assert got == {(1, "A//1"): None, (1, "B"): None, (2, "A//1"): True, (2, "B"): False}
    assert {r.slug for r in tasks.select("slug").distinct().collect()} == {slug("A//1"), slug("B")}
    external.write_per_code(tasks, str(tmp_path / "out"))
    assert sorted(n for n, d in files.entries(spark, str(tmp_path / "out")) if d) == sorted(f"slug={slug(c)}" for c in ("A//1", "B"))
    with pytest.raises(Exception, match="no row"):
        external.per_code_tasks(wide.where("subject_id = 1"), labels, ["B"], 30.0).collect()


def test_align(spark):
    frame = spark.createDataFrame([("x", 5, "2020-01-01 00:00:00", "A", 1)], "extra string, subject_id int, prediction_time string, query string, duration_days int")
    assert align(frame, INDEX).columns == [*INDEX.columns, "extra"]
    assert [f.dataType.simpleString() for f in align(frame, INDEX).schema][:4] == ["bigint", "timestamp_ntz", "string", "float"]
    with pytest.raises(SchemaError, match="boolean_value"):
        align(frame, PREDICTION)
    with pytest.raises(Exception, match="null in"):
        align(frame.selectExpr("extra", "cast(null as int) as subject_id", "prediction_time", "query", "duration_days"), INDEX).collect()
    assert TASK_QUERY.empty(spark, optional=False).columns == INDEX.columns and EVENT_LOG.empty(spark).count() == 0


def test_codes_sources(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# codes\ncodes:\n  - 'A//1'\n  - B # second\n  - 'A//1'\n")
    (tmp_path / "b.yaml").write_text("[X, \"Y\"]\n")
    (tmp_path / "bad.yaml").write_text("codes: 5\n")
    assert logs.read_codes(spark, str(tmp_path / "a.yaml")) == ["A//1", "B"]
    assert logs.read_codes(spark, str(tmp_path / "b.yaml")) == ["X", "Y"]
    assert logs.read_codes(spark, ["b", "a", "b"]) == ["b", "a"]
    spark.createDataFrame([("z",), ("a",), ("z",)], "code string").write.parquet(str(tmp_path / "v" / "metadata" / "codes.parquet"))
    assert logs.read_codes(spark, str(tmp_path / "v")) == ["a", "z"]
    for bad in (None, [], str(tmp_path / "bad.yaml"), [1]):
        with pytest.raises(ValueError):
            logs.read_codes(spark, bad)
    with pytest.warns(UserWarning):
        assert logs.read_vocabulary(spark, str(tmp_path / "none")).count() == 0


def test_preprocess(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(s, day(float(d)), c, float(v)) for s in range(40) for d, c, v in zip(np.cumsum(rng.integers(1, 9, 12)), rng.choice(["LAB", "RX", "ADMISSION//E"], 12), rng.normal(size=12), strict=True)]
    rows += [(0, day(500), "RARE", None), (39, None, "DEMO", None)]
    events = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, code string, numeric_value double")
    splits = spark.createDataFrame([(s, "train" if s % 4 else "tuning") for s in range(40)], "subject_id long, split string")
    out = preprocess.run(spark, events, splits, str(tmp_path / "p"), preprocess.PreprocessConfig(2, 3, per_shard=8))
    codes = spark.read.parquet(f"{out}/metadata/codes.parquet").toPandas()
    assert sorted(codes["code/vocab_index"]) == list(range(1, len(codes) + 1)) and "RARE" not in set(codes.code) and "DEMO" in set(codes.code)
    assert any(c.startswith("LAB//Q") for c in codes.code) and any(c.startswith("TIMELINE//DELTA//years//") for c in codes.code)
    data = spark.read.parquet(f"{out}/tokens")
    shards = {(r.split, str(r.shard)): r.n for r in data.groupBy("split", "shard").agg({"subject_id": "approx_count_distinct"}).withColumnRenamed("approx_count_distinct(subject_id)", "n").collect()}
    assert set(shards) == {("train", "0"), ("train", "1"), ("train", "2"), ("train", "3"), ("tuning", "0"), ("tuning", "1")}
    assert data.where("vocab_index = 0").count() == 0
    assert preprocess.run(spark, events.limit(0), splits, out) == out
    assert pp.filter_rare_codes(events, pp.count_codes(events), 1000).select("code").distinct().count() == 2


def test_sequences_and_predict(spark, tmp_path):
    events = log(spark, [(1, 0, "A"), (1, 1, "B"), (1, 5, "A"), (2, 0, "B")])
    vocabulary = spark.createDataFrame([("A", 1), ("B", 2)], "code string, vocab_index long")
    tasks = index(spark, [(1, 1, "B", 30), (1, 9, "A", 60), (99, 0, "A", 30)])
    found = {str(r.prediction_time.day): r for r in predict.assemble(tasks, events, vocabulary, 3).collect()}
    assert found["2"].codes == [2, 1, 2] and found["10"].codes == [1, 2, 1] and len(found) == 2
    assert found["10"].time_deltas == [0.0, 0.0, 4.0]
    nested = sq.subject_tokens(sq.encode(events.union(log(spark, [(1, 0, "B")])), vocabulary)).where("subject_id = 1")
    assert [[t.code for t in e] for e in nested.select(sq.by_event(nested.tokens).alias("e")).first().e] == [[1, 2], [2], [1]]
    align(tasks, TASK_QUERY).coalesce(1).toPandas().to_parquet(tmp_path / "tasks.parquet", coerce_timestamps="us")
    (tmp_path / "t").mkdir()
    (tmp_path / "tasks.parquet").rename(tmp_path / "t" / "0.parquet")
    out = str(tmp_path / "p.parquet")
    timing = predict.run(spark, str(tmp_path / "t"), events, vocabulary, out, lambda b: (*predict.logistic_scorer(b), np.ones((len(b), 4))), 8, embedding=4)
    assert timing["n_rows"] == 2 and spark.read.parquet(out).columns == PREDICTION.columns
    assert len(spark.read.parquet(files.sibling(out, "embeddings")).first().embedding) == 4
    with pytest.raises(FileExistsError):
        predict.run(spark, str(tmp_path / "t"), events, vocabulary, out)
    with pytest.raises(ValueError, match="vocabulary"):
        predict.run(spark, str(tmp_path / "t"), events, vocabulary.where("code = 'B'"), str(tmp_path / "q.parquet"))
    with pytest.raises(Exception, match="wide"):
        predict.score(predict.assemble(tasks, events, vocabulary, 3), lambda b: (*predict.logistic_scorer(b), np.ones((len(b), 3))), 4).collect()
    metrics = evaluation.evaluate(spark, out, str(tmp_path / "m.parquet"))
    assert metrics.count() == 2
    (tmp_path / "t" / "x.csv").write_text("no")
    with pytest.raises(ValueError, match="Parquet"):
        logs.validate_task_dir(spark, str(tmp_path / "t"))
    with pytest.raises(NotADirectoryError):
        logs.validate_task_dir(spark, str(tmp_path / "none"))


def test_label_round_trip_and_fingerprint(spark):
    frame = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, boolean_value boolean")
    split = lb.split_label(frame)
    assert {(r.id, r.boolean_value, r.occurs) for r in split.collect()} == {(1, False, True), (2, False, False), (3, True, False)}
    merged = split.select("id", lb.merge_label(split.boolean_value, split.occurs).alias("boolean_value"))
    assert sorted(merged.collect(), key=str) == sorted(frame.collect(), key=str)
    assert lb.split_label(split) is split
    a = lb.fingerprint(frame).first()[0]
    assert a == lb.fingerprint(frame.repartition(3).select("boolean_value", "id")).first()[0] != lb.fingerprint(frame.union(frame.limit(1))).first()[0]


def test_files_and_cli(spark, tmp_path, data_dir, capsys):
    assert files.sibling("/a/p.parquet", "timing") == "/a/p.timing.parquet"
    assert files.artifacts_root("/a/tasks/") == "/a/tasks_artifacts"
    with pytest.raises(ValueError):
        files.artifacts_root("/")
    path = str(tmp_path / "x.json")
    files.write_json(spark, path, {"b": 1, "a": 2})
    assert files.read_json(spark, path) == {"a": 2, "b": 1} and files.read_json(spark, str(tmp_path / "none")) is None
    (tmp_path / "left.tmp").write_text("x")
    assert files.clean_temps(spark, str(tmp_path)) == 1
    from hindcast import cli

    for command in ("preprocess", "training-tasks", "evaluation-tasks", "predict", "evaluate", "composites", "per-code-tasks", "per-code-auroc"):
        with pytest.raises(SystemExit) as stop:
            cli.main([command, "--help"])
        assert stop.value.code == 0
    assert cli.main(["training-tasks", "--data", data_dir, "--output", str(tmp_path / "cli"), "--codes", ",".join(SYNTHETIC), "--queries", "3", "--contexts", "2", "--min-times", "5"]) == 0
    assert '"n_rows": 6' in capsys.readouterr().out


def test_streaming(spark, tmp_path):
    from hindcast.streaming import outcomes

    rows = [(1, 3, "A"), (1, 100, "B"), (2, 10, "B"), (3, 100, "A")]
    log(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log(spark, rows).schema).parquet(str(tmp_path / "in"))
    tasks = index(spark, [(1, 0, "A", 7), (2, 0, "A", 30), (3, 0, "A", 7)])
    query = outcomes.first_hits(tasks, stream).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    hits = spark.table("hits")
    got = {r.subject_id: r.boolean_value for r in outcomes.close(tasks, hits, ev.last_times(log(spark, rows))).collect()}
    assert got == {1: True, 2: None, 3: False}
    counts = outcomes.event_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert spark.table("counts").agg({"n": "sum"}).first()[0] == 4


def test_relabels_only_shards_that_changed(spark, data_dir, tmp_path):
    config = lambda **kw: training.TrainingConfig(data_dir, str(tmp_path / "t"), list(SYNTHETIC), n_queries=6, contexts_per_query=4, least_times=5, **kw)
    training.run(spark, config())
    cfg = config()
    rows = lambda: sorted(map(tuple, spark.read.parquet(f"{cfg.output_dir}/train").collect()), key=str)
    before = rows()
    assert set(training.label_shards(spark, cfg).values()) == {"kept"}
    shards = sorted(training.label_shards(spark, cfg))
    files.delete(spark, f"{cfg.output_dir}/train/shard={shards[0]}")
    (tmp_path / "t" / "train" / "shard=gone").mkdir()
    status = training.label_shards(spark, cfg)
    assert status == {s: "labeled" if s == shards[0] else "kept" for s in shards} and rows() == before
    assert not files.exists(spark, f"{cfg.output_dir}/train/shard=gone")


def test_replacing_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x")
    files.write_parquet(spark.range(3), path)
    files.write_parquet(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [n for n, _ in files.entries(spark, str(tmp_path))] == ["x"]
    with pytest.raises(ValueError, match="wrong"):
        files.write_all({path: spark.range(9), str(tmp_path / "y"): spark.range(1)}, lambda temps: (_ for _ in ()).throw(ValueError("wrong")))
    assert spark.read.parquet(path).count() == 5 and not files.exists(spark, str(tmp_path / "y"))
    # a run that broke between moving the old table aside and renaming the new one
    (tmp_path / "x").rename(tmp_path / ("x." + "0" * 32 + files.REPLACED))
    files.clean_temps(spark, str(tmp_path))
    assert spark.read.parquet(path).count() == 5
    files.write_csv(spark.range(2), str(tmp_path / "c.csv"))
    with pytest.raises(FileExistsError):
        files.write_csv(spark.range(2), str(tmp_path / "c.csv"))
    assert files.stamped("/a/c.csv", BASE) == "/a/c.20200101T000000.csv"


@pytest.mark.parametrize(
    ("text", "codes"),
    [("[a, 'b,c']", ["a", "b,c"]), ("- 'x # y'\n- b # c\n", ["x # y", "b"]), ('---\ncodes: [a, "q\\"r", ]\n', ["a", 'q"r']), ("- a: b\n- c#d\n", ["a: b", "c#d"]), ("[\n  'it''s',  # one\n  b\n]", ["it's", "b"])],
)
def test_parse_codes(text, codes):
    assert logs.parse_codes(text) == codes


def test_label_files_must_agree(spark, tmp_path):
    labels = index(spark, [(1, 0, "A", 7)]).selectExpr("*", "1 AS extra")
    (tmp_path / "l").mkdir()
    labels.coalesce(1).toPandas().to_parquet(tmp_path / "l" / "0.parquet", coerce_timestamps="us")
    labels.drop("extra").toPandas().to_parquet(tmp_path / "l" / "1.parquet", coerce_timestamps="us")
    assert logs.read_labels(spark, str(tmp_path / "l")).columns == ["subject_id", "prediction_time", "query", "duration_days"]
    labels.drop("query").toPandas().to_parquet(tmp_path / "l" / "2.parquet", coerce_timestamps="us")
    with pytest.raises(ValueError, match="differ"):
        logs.read_labels(spark, str(tmp_path / "l"))


def test_batches():
    import pandas as pd

    batch = pd.DataFrame({"codes": [[3, 1], [2]], "numeric_values": [[np.nan, 0.5], [np.nan]], "time_deltas": [[0.0, 2.0], [0.0]], "duration_days": [365.0, 73.0], "boolean_value": [True, None]})
    predict.check_batch(batch, 2, 4, "SEM")
    for bad in ({"longest": 1}, {"n_codes": 3}, {"mode": "X"}):
        with pytest.raises(ValueError):
            predict.check_batch(batch, **bad)
    with pytest.raises(ValueError, match="padding"):
        predict.check_batch(batch.assign(codes=[[3, 1], [0]]))
    got = predict.collate(batch)
    assert got["code"].tolist() == [[3, 1], [2, 0]] and got["mask"].tolist() == [[True, True], [True, False]]
    assert got["query"].tolist() == [3, 2] and got["durations"].tolist() == pytest.approx([1.0, 0.2])
    assert got["censored"].tolist() == [False, True] and got["occurs"].tolist() == [True, False]
    assert got["numeric_value"].tolist() == [[0.0, 0.5], [0.0, 0.0]] and got["numeric_value_mask"].tolist() == [[False, True], [False, False]]
    embedded, mask = predict.with_duration(np.zeros((2, 2, 3)), got["mask"], np.ones((2, 3)))
    assert embedded.shape == (2, 3, 3) and embedded[:, 1].all() and mask.tolist() == [[True, True, True], [True, True, False]]
    assert predict.collate(batch.iloc[:0])["code"].shape == (0, 0)


def test_query_record_and_alignment(spark):
    frame = spark.createDataFrame([(5,)], "query_index long")
    flat, nested = (frame.select(sq.query_record(m).alias("r")).first().r for m in sq.MODES)
    assert flat.code == [5] and nested.code == [[5]] and all(np.isnan(x) for r in (flat, nested) for x in (*r.numeric_value, *r.time_delta_days))
    with pytest.raises(ValueError):
        sq.query_record("X")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    assert [(r.row, r.id) for r in sq.surviving(rows, rows.where("id != 2"), ["id"]).orderBy("row").collect()] == [(0, 1), (2, 3)]


def test_losses(spark):
    rows = [(True, 0.0, 1.0), (False, 2.0, -1.0), (None, 9.0, 0.0)]
    frame = spark.createDataFrame(rows, "boolean_value boolean, occurs_logit double, censor_logit double")
    got = mt.losses(frame, 0.25).first()
    bce = lambda x, y: np.log1p(np.exp(-abs(x))) + max(x, 0) - x * y
    occurs, censor = (bce(0.0, 1) + bce(2.0, 0)) / 2, (bce(1.0, 0) + bce(-1.0, 0) + bce(0.0, 1)) / 3
    assert (got.occurs_loss, got.censor_loss, got.loss) == pytest.approx((occurs, censor, 0.25 * occurs + 0.75 * censor))
    assert mt.losses(frame.where("boolean_value is null")).first().occurs_loss == 0
    far = spark.createDataFrame([(False, 800.0, -800.0)], frame.schema)
    assert mt.losses(far).first().occurs_loss == 800 and mt.losses(far).first().censor_loss == 0


def test_normalisation_and_nested_tokens(spark):
    rows = [(1, day(0), "A", 1.0), (1, day(0), "B", None), (1, day(3), "A", 3.0), (1, None, "S", 2.0), (2, day(1), "A", float("nan")), (2, day(1), "gone", 1.0)]
    events = spark.createDataFrame(rows, "subject_id long, time timestamp_ntz, code string, numeric_value double")
    vocabulary = pp.vocabulary(events.where("code != 'gone'"))
    made = pp.normalise_values(events, vocabulary, pp.fit_normalisation(events))
    assert made.count() == 5
    seqs = {r.subject_id: r for r in pp.event_sequences(made).collect()}
    assert seqs[1].code == [[1, 2], [1]] and seqs[1].numeric_value == [[-1.0, None], [1.0]] and seqs[1].time_delta_days == [None, 3.0]
    assert seqs[2].code == [[1]] and seqs[2].numeric_value == [[None]]
    schemas = {r.subject_id: r for r in pp.subject_schemas(made).collect()}
    assert schemas[1].code == [3] and schemas[1].numeric_value == [0.0] and schemas[1].time == [day(0), day(3)] and schemas[2].code == []


def test_per_code_commands(spark, tmp_path):
    wide = spark.createDataFrame([(i, BASE, False, i % 2 == 0, i % 3 == 0) for i in range(12)], "subject_id long, prediction_time timestamp_ntz, censored boolean, `A//1` boolean, B boolean")
    wide.write.parquet(str(tmp_path / "wide"))
    wide.selectExpr("subject_id", "prediction_time", "B as boolean_value").write.parquet(str(tmp_path / "labels"))
    out = external.run_per_code(spark, str(tmp_path / "wide"), str(tmp_path / "labels"), ["A//1", "B"], str(tmp_path / "tasks"), 30.0)
    with pytest.raises(FileExistsError):
        external.run_per_code(spark, str(tmp_path / "wide"), str(tmp_path / "labels"), ["B"], out, 30.0)
    assert {r.slug for r in external.read_per_code(spark, out).select("slug").distinct().collect()} == {slug("A//1"), slug("B")}
    micros = 1_577_836_800_000_000  # BASE
    spark.createDataFrame([(i, micros, c, (i % 2 == 0) + 0.01 * i if c == "A//1" else 0.5) for i in range(12) for c in ("A//1", "B")], "subject_id long, prediction_time long, code string, occurs_probs double").coalesce(1).write.csv(str(tmp_path / "p"), header=True)
    found = {r["query"]: r.auroc for r in external.run_per_code_auroc(spark, str(tmp_path / "p"), out, str(tmp_path / "auroc.csv")).collect()}
    assert found == {"A//1": 1.0, "B": 0.5}
    assert len([n for n, _ in files.entries(spark, str(tmp_path)) if n.startswith("auroc.")]) == 1
