import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline
from marginalia.llm.decontamination import decontamination_report
from marginalia.llm.language_id import has_letter
from marginalia.llm.simhash import keep_one_each

SF = "/root/testdata/sf0.01"


def test_each_stage_and_the_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.columns == columns and set(rows) <= set(before)
        if name == "language_id":
            assert all(has_letter(t) for t in rows.values())
            assert all(rows[i] == before[i] for i in rows)
        if name == "line_dedup":
            assert set(rows) == set(before)  # lines go, rows stay
            lines = {}
            for i in sorted(before):
                for line in set((before[i] or "").split("\n")):
                    lines.setdefault(line, []).append(i)
            for line, ids in lines.items():
                if len(ids) >= 3 and len(line.split()) >= 3:
                    assert sum(line in (rows[i] or "").split("\n") for i in ids) <= 1
            assert all({*(rows[i] or "").split("\n")} <= {*(before[i] or "").split("\n"), ""} for i in rows)
            assert {r["doc_id"] for r in out.collect() if r["n_chars"] != len(r["text"] or "")} <= {r["doc_id"] for r in docs.collect() if r["n_chars"] != len(r["text"] or "")}
        if name == "simhash_near_dedup":
            assert set(rows) == {r["doc_id"] for r in keep_one_each(docs).collect()}
            grams = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() for w in [(t or "").lower().split()]}
            holders = {}
            for i, found in grams.items():
                for g in found:
                    holders.setdefault(g, []).append(i)
            both = Counter(pair for ids in holders.values() for pair in combinations(sorted(ids), 2))
            near = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(grams[a]) + len(grams[b]) - n)]
            assert near and sum(not {a, b} <= set(rows) for a, b in near) >= 0.95 * len(near)
            lone = set(before) - {i for (a, b), n in both.items() if n >= 0.6 * (len(grams[a]) + len(grams[b]) - n) for i in (a, b)}
            assert lone <= set(rows)  # clean documents stay
        if name == "decontamination":
            hit = {r["doc_id"] for r in decontamination_report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r["contaminated"]}
            assert hit and set(rows) == set(before) - hit
        kept.append(len(rows))
        docs, before = spark.createDataFrame(out.collect(), out.schema), rows
    assert kept[-1] > 0
    final = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        final.setdefault(r["doc_id"], []).append(r)
    assert {i: zlib.crc32((t or "").encode()) for i, t in before.items()} == {i: rows[0]["decoded_crc32"] for i, rows in final.items()}
    assert all(len({tuple(r["ids"]) for r in rows}) == len(rows) <= 2 for rows in final.values())


def test_odd_rows_pass_through_every_stage(spark, make_docs, odd_rows, tmp_path):
    spark.createDataFrame([(1, "not in there at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd_rows, []):
        docs = make_docs(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= len(rows)
        assert {r["doc_id"] for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()} == {r[0] for r in rows}
