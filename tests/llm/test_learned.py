"""Language identification, toxicity and the pipeline: plain recursions, held-out accuracy, brute-force stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from odd_rows import ODD
from test_joins_and_sketches import brute_components
from warden.llm import language_id, packing, toxicity
from warden.llm.queries import table, tokenizer_file

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages(spark):
    return language_id.train(table(spark, SF, "documents"))


@pytest.fixture(scope="module")
def insults(spark):
    return toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_marginals_equal_the_plain_recursions():
    rng, k = np.random.default_rng(0), 3
    lengths = np.array([0, 1, 5, 64, 65, 200, 0, 129])
    emissions, transitions = rng.normal(size=(lengths.sum(), k)) * 3, rng.normal(size=(k, k))
    got, counts = language_id.marginals(emissions, lengths, transitions)
    want, pairs, at = [], np.zeros((k, k)), 0
    step = np.exp(transitions)
    for n in lengths:
        e = np.exp(emissions[at : at + n])
        at += n
        forward, back = [], [np.ones(k)]
        for t in range(n):
            a = ((forward[-1] if t else np.ones(k)) @ step) * e[t]
            forward.append(a / a.sum())
        for t in range(n - 1, 0, -1):
            b = step @ (e[t] * back[0])
            back.insert(0, b / b.sum())
        for t in range(n):
            g = forward[t] * back[t]
            want.append(g / g.sum())
            if t:
                p = forward[t - 1][:, None] * step * (e[t] * back[t])[None]
                pairs += p / p.sum()
    assert np.allclose(got, want) and np.allclose(counts, pairs)


def test_held_out_languages(spark, languages):
    docs = table(spark, SF, "documents")
    rows = language_id.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows) > 100
    assert all(0 <= r.score <= 1 for r in rows)


def test_switched_text_is_labelled_word_by_word(documents, languages):
    words = {lang: [w for w, k in languages.lexicons.items() if k == [i]][:12] for i, lang in enumerate(languages.labels)}
    a, b = "en", "fr"
    row = language_id.label_words(documents([(1, " ".join(words[a] + words[b]))]), languages).first()
    assert np.mean([x == y for x, y in zip(row.languages, [a] * len(words[a]) + [b] * len(words[b]), strict=True)]) > 0.85


def test_language_of_odd_rows(documents, languages, spark):
    got = language_id.identify(documents(ODD + [(20, "12 34 -- !")]), languages).collect()
    assert len(got) == len(ODD) + 1
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (1, 2, 3, 20))
    empty = language_id.train(documents(ODD))  # no language is known
    assert {r.lang_pred for r in language_id.identify(documents(ODD), empty).collect()} == {"und"}
    assert language_id.identify(documents(ODD).limit(0), languages).collect() == []


def test_held_out_toxicity(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    found = [r for r in rows if r.toxic == 1]
    clean = [r for r in rows if r.toxic == 0]
    ranked = np.mean([[(a.score > b.score) + (a.score == b.score) / 2 for b in clean] for a in found])
    assert ranked > 0.85 and np.mean([r.predicted for r in clean]) < 0.1


def made_up_insults():
    rng = np.random.default_rng(0)
    syllables = ["ba", "to", "ri", "men", "sul", "ka", "ver", "lon", "dis", "pe", "gu", "nar"]
    clean = sorted({"".join(rng.choice(syllables, rng.integers(1, 5))) for _ in range(3000)})
    insults = ["zwackel", "fripnox", "zwackeln", "hujuxi"]
    toxic = {i: [insults[i % 4], insults[(i // 4) % 4], "".join(rng.choice(syllables, 6))] for i in range(60)}
    return toxic, dict.fromkeys(clean, 3)


def test_kernel_tolerates_gaps_and_inserted_characters():
    toxic, clean = made_up_insults()
    model = toxicity.fit(toxic, clean, {n: 2000 // n**2 for n in range(1, 20)})
    likely = model.score(["a zwackel b", "zw-ackel", "zwaackel", "zwa.ckel", "z w a c k e l", "FRIPNOX!", "fri*pnox"])
    assert (likely >= toxicity.THRESHOLD).all()
    assert (model.score([*list(clean)[:500], "", "  ", "zw"]) < toxicity.THRESHOLD).all()


def test_kernel_is_that_of_weighted_subsequences():
    sub = toxicity.Subsequences({c: i + 1 for i, c in enumerate("abcdefgh")})
    words = ["abc", "abxc", "aabbcc", "hgfedcba", "b", ""]

    def vector(word):
        out, marked = {}, "^" + word
        for i in range(len(marked)):
            for j in range(i + 1, len(marked)):
                for k in range(j + 1, min(len(marked), i + toxicity.SPAN + 1)):
                    u = marked[i] + marked[j] + marked[k]
                    if "x" not in u:
                        out.setdefault(u, []).append(toxicity.DECAY ** (k - i + 1))
        norm = np.sqrt(sum(v * v for vs in out.values() for v in vs) + 1e-12)
        return {u: sum(vs) / norm for u, vs in out.items()}

    plain = [vector(w) for w in words]
    want = [[sum(a.get(u, 0) * v for u, v in b.items()) for b in plain] for a in plain]
    assert np.allclose(sub.score(words, sub.vectors(words)), want, atol=1e-5)


def test_toxicity_of_odd_rows(documents, spark, insults):
    got = toxicity.score(documents(ODD), insults).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score < toxicity.THRESHOLD for r in got)
    none = toxicity.train(documents(ODD), spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    assert {r.score for r in toxicity.score(documents(ODD), none).collect()} == {0.0}
    assert toxicity.score(documents(ODD).limit(0), insults).collect() == []


def test_pipeline_stages_take_effect(spark, languages, insults):
    docs = table(spark, SF, "documents")
    rows = docs.collect()
    texts = [r.text or "" for r in rows]
    left = [r for r, (_, s, _) in zip(rows, languages.predict(texts), strict=True) if s >= corpus_pipeline.LEAST_SCORE]
    first = corpus_pipeline.known_language(spark, docs, SF)
    assert first.columns == docs.columns and sorted(first.collect()) == sorted(left)
    model = toxicity.train(spark.createDataFrame(left, docs.schema), table(spark, SF, "labels"))
    left = [r for r, s in zip(left, model.score([r.text or "" for r in left]), strict=True) if s < toxicity.THRESHOLD]
    keep = {c for _, _, c in brute_components([(r.doc_id, r.text) for r in left])}
    left = [r for r in left if r.doc_id in keep]
    want = packing.pack(spark.createDataFrame(left, docs.schema), tokenizer_file("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
    assert 0 < len(left) < len(rows)
    assert got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_pipeline_on_odd_rows(spark, tmp_path, documents):
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for i, rows in enumerate((ODD, [])):
        documents(rows, lang="'en'").write.parquet(f"{tmp_path}/{i}/documents.parquet") if rows else documents(ODD, lang="'en'").limit(0).write.parquet(f"{tmp_path}/{i}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/{i}/labels.parquet")
        assert len(corpus_pipeline.run(spark, f"{tmp_path}/{i}").collect()) >= (1 if rows else 0)
