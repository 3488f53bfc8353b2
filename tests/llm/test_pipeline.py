import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from waymesh.llm import decontaminate, mixing, quality, repeats, simhash


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(12)
    stems = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(2, 8))) for _ in range(4000)]
    words = lambda n: [rng.choice(stems) for _ in range(n)]
    passage, item = " ".join(words(100)), " ".join(words(40))
    docs = [[i, " ".join(words(rng.randint(150, 400))) + ".", "en", f"s{i % 4}"] for i in range(120)]
    for i in range(5):
        docs[i][1] += " " + passage
        docs[10 + i][1] += " " + item
        docs[20 + i][1] = "WOW!! " * 90
        docs[30 + i][1] = docs[40 + i][1]
        docs[50 + i][1] = docs[60 + i][1].replace(" ", "  ")
    docs += [[900, None, None, None], [901, "", "en", "s1"], [None, " ".join(words(200)), "en", "s2"], docs[70], docs[70]]
    sf = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(not 20 <= i < 25), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, docs, passage, item


def test_stages_take_effect(spark, corpus):
    sf, docs, passage, item = corpus
    rows = P.run(spark, sf).collect()
    by_id = {r.doc_id: r for r in rows}
    assert not set(range(10, 15)) & set(by_id) and not set(range(20, 25)) & set(by_id)
    assert not set(range(40, 45)) & set(by_id) and not set(range(60, 65)) & set(by_id)
    clean = set(range(120)) - set(range(10, 15)) - set(range(20, 25)) - set(range(40, 45)) - set(range(60, 65))
    assert clean <= set(by_id) and None in by_id and Counter(r.doc_id for r in rows)[70] == 1
    assert all(passage not in by_id[i].text and by_id[i].n_chars == len(by_id[i].text) for i in range(5))
    assert all(by_id[i].text == docs[i][1] for i in clean if i >= 5)
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and 0 <= r.taken <= 2 * r.size for r in rows)


def test_each_stage_on_its_own_input(spark, corpus):
    """Each stage against its operator's brute-force tested result, on repeated, null and oddly named rows."""
    sf, *_ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"score": F.lit(1), "key": F.lit("x"), "size": F.lit(0), "component_id": F.lit(2)})
    n = docs.count()
    kept = P.quality_classifier(spark, docs, sf)
    assert kept.columns == P.COLUMNS and 0 < kept.count() <= n - 5
    groups = {r.component_id for r in simhash.similar_groups(docs).collect()}
    assert P.simhash_near_duplicates(spark, docs, sf).count() == len(groups)
    cut = {(r.doc_id, r.n_removed > 0): r.kept for r in repeats.without_repeats(docs, length=P.REPEAT_BYTES, gram=P.REPEAT_GRAM).collect()}
    for r in P.suffix_array_dedup(spark, docs, sf).collect():
        assert r.text in {bytes(x).decode("utf-8", "ignore") for (i, _), x in cut.items() if i == r.doc_id}
    leaked = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    stay = P.benchmark_decontamination(spark, docs, sf).collect()
    assert leaked == set(range(10, 15)) and len(stay) == n - 5
    mixed = P.source_mixing(spark, docs, sf).collect()
    assert len(mixed) == n and sum(r.taken for r in mixed) > 0
    assert [name for name, _ in P.STAGES][0] == "quality classifier" and quality.THRESHOLD == 0.3 and mixing.GROWTH == 1.5


def test_empty_table(spark, corpus):
    sf, *_ = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_passages_of_short_words_go(spark, corpus):
    sf, *_ = corpus
    rng = random.Random(2)
    words = lambda n, m: " ".join("".join(rng.choices("abcdefghik", k=rng.randint(1, m))) for _ in range(n))
    passage = words(51, 4)
    docs = spark.createDataFrame([(i, f"{words(80, 9)} {passage} {words(80, 9)}", "en", "s", 0) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(passage) < 200 and all(passage not in r.text and len(r.text) > 500 for r in P.suffix_array_dedup(spark, docs, sf).collect())
