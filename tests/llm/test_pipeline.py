import collections

import corpus_pipeline
from corpus import SMALL, small

from regimen.llm import decontaminate, lines, ngrams, packing, quality


def test_stages_in_order_and_registered():
    import __spark_entry__ as entry
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_each_stage_on_its_predecessor(spark):
    """Every stage's decisions, against its operator's report on the same input."""
    docs = small(spark, "documents").checkpoint()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_classifier"](spark, docs, SMALL).checkpoint()
    scored = quality.classify(docs, small(spark, "labels"))
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in scored.where("predicted = 1").collect()}

    unlined = stages["line_dedup"](spark, good, SMALL).checkpoint()
    report = {r["doc_id"]: r for r in lines.report(good).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (good, unlined))
    assert unlined.columns == columns
    for i, text in before.items():
        left = [x for x in text.split("\n")]
        assert i not in after or len(after[i].split("\n")) == len(left) - report[i]["n_removed"]
        assert i in after or report[i]["n_removed"] > 0

    unique = stages["ngram_jaccard_join"](spark, unlined, SMALL).checkpoint()
    kept = {r["doc_id"] for r in ngrams.join(unlined).where("kept").collect()}
    assert unique.columns == columns and {r["doc_id"] for r in unique.collect()} == kept

    clean = stages["benchmark_decontamination"](spark, unique, SMALL).checkpoint()
    hit = {r["doc_id"] for r in decontaminate.report(unique, small(spark, "benchmark")).where("contaminated").collect()}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == kept - hit

    packed = stages["best_fit_packing"](spark, clean, SMALL).collect()
    sums = collections.Counter()
    for r in packed:
        sums[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in packed} == kept - hit and max(sums.values()) <= 1024
    assert sum(sums.values()) == packing.pieces(clean).agg({"length": "sum"}).first()[0]


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
