"""The pipeline's stages against plain Python, and null ids and repeated rows through every operator."""

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from armwise.llm import class_lm, decontamination, exact_dedup, jaccard_join, language_id, mixing, secret_scan, substring_dedup, token_output, toxicity
from armwise.llm import common as C
from armwise.llm.queries import byte_bpe
from tests.llm.test_operators import SCHEMA, corpus, words


def shingles(text):
    w = words(text, True)
    return {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def first_of_groups(texts):
    """Ids that are the smallest of all that links reach from them."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if both and root[i] != root[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {i for i in root if root[i] == i}


def goals(size):
    """Target of each source: shares by weight, full sources stop at 3 times their size."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(weight[s] for s in size if s not in full)
        over = {s for s in size if s not in full and level * weight[s] > 3 * size[s]}
        if not over:
            return {s: 3 * size[s] if s in full else level * weight[s] for s in size}
        full |= over


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    passage = " ".join(corpus()[7][1].split()[-60:-20])
    spark.createDataFrame([(*r, 1, 2, 3, "x") for r in corpus()], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = C.documents(spark, str(tmp_path)), []
    for name, stage in corpus_pipeline.STAGES:
        docs = C.written(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs)
        assert name == "encode" or docs.dtypes == C.documents(spark, str(tmp_path)).dtypes
    texts = {i: t for i, t, *_ in corpus()}
    lettered = {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    del lettered[5]  # letters that no row has which is learned from: the only row in its language is held out
    assert sorted(r.doc_id for r in kept[0].collect()) == sorted(lettered)
    single = first_of_groups(lettered)
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted(single) and len(single) < len(lettered)
    clean = {i for i in single if passage not in " ".join((texts[i] or "").split())}
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted(clean) and len(clean) < len(single)

    size, took = collections.Counter(), collections.Counter()
    for i, text, _, source in corpus():
        if i in clean:
            size[source] += len(words(text))
    mixed = kept[3].collect()
    for r in mixed:
        took[r.source] += len(words(r.text))
        assert r.doc_id in clean and " ".join(r.text.split()) in " ".join(texts[r.doc_id].split())
    goal = goals(size)
    assert all(abs(took[s] - goal[s]) <= 1 for s in goal)

    tokenizer = Tokenizer.from_file(byte_bpe())
    coded = lambda t: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
    want = sorted((r.doc_id, len(coded(r.text)), zlib.crc32(coded(r.text).tobytes())) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in kept[4].collect()) == want
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_language_stage(spark, tmp_path):
    """Languages of the labelled rows stay, an unseen script and texts without letters go; rows are judged by themselves."""
    known = C.documents(spark, "/root/testdata/sf0.01")
    more = [(10**9 + 1, "Съешь же ещё этих мягких французских булок да выпей чаю. " * 20), (10**9 + 2, "12 34 !"), (10**9 + 3, None), (None, "-- 1"), (None, known.where("lang = 'en' and length(text) > 500").first().text)]
    rows = known.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(*r, None, "s") for r in more], "doc_id bigint, text string, lang string, source string"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    docs = C.documents(spark, str(tmp_path))
    kept = [r.doc_id for r in corpus_pipeline.language(spark, docs, str(tmp_path)).select("doc_id").collect()]
    assert not {10**9 + 1, 10**9 + 2, 10**9 + 3} & set(kept) and kept.count(None) == 1
    lettered = known.where("text rlike '[A-Za-z]'").count()
    assert lettered * 0.995 <= len(kept) - 1 <= lettered
    assert corpus_pipeline.language(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_language_model_of_all_rows(spark):
    """Prototypes and the least cosine come from every labelled row: 24,000 of them, each of which counts."""
    names = ["aa", "bb"]
    texts = [[f"{a}{b}{c} {c}{a} {b}{a}{c}" for a in half for b in half for c in half] for half in ("abcdefghij", "pqrstuvwxy")]
    rows = [(i, texts[i % 2][i // 2 % 1000], names[i % 2]) for i in range(24_000)]
    docs = C.written(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "fixture")
    known = language_id.prototypes(docs)
    profiler = language_id.Profiler()
    for k, name in enumerate(names):
        vectors, _ = profiler.vectors(texts[k])
        total = 12 * np.rint(vectors * 2**20).sum(axis=0)
        assert np.array_equal(known[name], total / np.linalg.norm(total))

    found = C.written(language_id.identify(docs, known, also=("lang",)), "found")
    cosines = np.sort([r.cosine for r in found.collect()])
    cell = 1 / language_id.FLOOR_CELLS
    least = language_id.least_cosine(found) / language_id.FLOOR_PART
    assert (cosines < least).sum() <= language_id.FLOOR_SHARE * len(cosines) < (cosines < least + cell).sum()
    low = spark.range(24_000).select("id", F.lit("aa").alias("lang_pred"), F.when(F.col("id") < 241, 0.25).otherwise(0.5).alias("cosine"))
    assert language_id.least_cosine(low) == 0.125 and language_id.least_cosine(low.where("id > 1")) == 0.25
    assert language_id.least_cosine(low.limit(0)) == 0.0


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_ids_and_repeated_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text, "en", None), (None, None, None, None), (7, text, "en", "a"), (7, text, "en", "a"), (8, "", None, "b")]
    docs = C.written(spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA), "fixture")

    cut = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert cut == [(0, 0, 0), (0, 40, 40), (7, 40, 0), (7, 40, 40), (8, 0, 0)]
    assert secret_scan.scan_secrets(docs).count() == 5
    groups = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.similar_groups(docs).collect())
    assert groups == [(0, 0), (0, 7), (7, 7), (7, 7), (8, 8)]
    assert sorted(r.doc_id or 0 for r in jaccard_join.keep_one(docs).collect()) == [0, 7, 8]
    assert language_id.identify(docs, language_id.prototypes(docs)).count() == 5
    token_output.write_ids(docs, str(tmp_path / "ids"), byte_bpe())
    assert token_output.read_documents(spark, str(tmp_path / "ids")).count() == 5
    assert mixing.mix(docs)[1].count() == 5
    bench = spark.createDataFrame([(1, text), (None, text), (3, None)], "item_id int, text string")
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in decontamination.overlaps(docs, bench).collect()) == [(0, 0), (0, 1), (7, 0), (7, 1)]
    assert sorted((r.doc_id or 0, r.text) for r in decontamination.clean(docs, bench).collect()) == [(0, None), (8, "")]
    assert exact_dedup.exact_groups(docs).where("kept").count() == 2
    assert class_lm.score_texts(docs).count() == 5
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (None, None)], "doc_id bigint, toxic int")
    assert toxicity.score_texts(docs, toxicity.fit(docs, labels)).count() == 5


def test_own_columns_stay(spark):
    """Columns of the user with the names that the operators use inside, and ids and texts under such names."""
    odd = ["__key", "__first", "__words", "__rejected", "__salt", "__row", "__leaf0", "own__key"]
    rows = [(i % 30 if i % 9 else None, f"some words of a text that is number {i % 20} of them all " * 3, "en", "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns({c: F.concat(F.lit(c), F.col("text")) for c in odd})
    bench = spark.createDataFrame([(1, "a passage that no document has, of quite other origin and with fifteen tokens or more")], "item_id int, text string")
    found = {
        "copies": exact_dedup.drop_copies(docs), "near": jaccard_join.keep_one(docs), "clean": decontamination.clean(docs, bench), "mixed": mixing.mixed_documents(docs), "language": corpus_pipeline.language(spark, docs, ""),
        "named": exact_dedup.drop_copies(docs.withColumnRenamed("doc_id", "__id"), id_col="__id").withColumnRenamed("__id", "doc_id"),
    }
    sizes = {}
    for name, out in found.items():
        assert out.columns == docs.columns, name
        kept = out.collect()
        sizes[name] = len(kept)
        if name != "mixed":
            assert all(r[c] == c + r.text for r in kept for c in odd), name
    assert sizes["copies"] == sizes["named"] == 20 and sizes["language"] == 60 and sizes["clean"] == 60 and sizes["near"] <= 20
