"""Personal data, page text, language model, toxicity and the pipeline."""

import hashlib
import time
import math
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm import brute
from wavetrail.llm import html_text, katz, pii, toxicity

TEXTS = [
    None, "", "no data", "ann.b_c@mail.example.com, x@y and a@b.c_d@e.f", "é 1.2.3.4 256.1.1.1 01.002.3.255 1.2.3.4.5 9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004", "+1 (202) 555-0143. +49 30 1234567 +1 2 +12 34 56",
    "1" * 4_000, "a" * 20_000, "a@" + ".b" * 5_000, "+" * 3_000, "x@" * 2_000, "1.2." * 3_000,
    "call 0049 30 1234 567 or (555) 123-4567", "mail jane at example dot com, meet at noon. Then",
]


def test_base_spans_equal_the_plain_search(docs):
    got = {r.doc_id: r for r in pii.span_report(docs(TEXTS)).collect()}
    for i, text in enumerate(TEXTS):
        want = brute.base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in want) for k in pii.KINDS]
        assert set(want) <= set(got[i].spans.split(",")) | {""}
    more = lambda i: set(got[i].spans.split(",")) - set(brute.base_spans(TEXTS[i])) - {""}
    assert more(13) and all(s.startswith("phone") for s in more(13))
    assert {TEXTS[14][int(s.split(":")[1]) : int(s.split(":")[2])] for s in more(14)} == {"jane at example dot com"}
    assert pii.span_report(docs([])).isEmpty()


def test_finding_many_matches_in_one_text_is_not_quadratic(docs):
    text = "é " + " ".join(f"{10 + i % 90}{'.,;'[i % 3]}" if i % 50 else f"10.0.{i % 256}.7 x{i}@y.org" for i in range(40_000))
    begin = time.time()
    column = F.col("text")
    got = docs([text]).select(pii.base_spans(column).alias("base"), F.size(pii.candidate_spans(column)).alias("more")).first()
    assert time.time() - begin < 20  # 105 s with one growing array, for the base spans alone
    assert [f"{pii.KINDS[x.kind]}:{x.s}:{x.e}" for x in got.base] == brute.base_spans(text)
    assert got.more > 30_000


def test_the_fit_counts_the_spans_of_all_texts(spark):
    n = 9_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("é a@b.example.com or 1.2.300."), F.col("id") % 7).alias("text"))
    values, weight, positive = pii.training_rows(rows)
    heavy = 3 * n / 200  # an address, a refused ip and its three digits as a refused card
    assert weight.sum() == pytest.approx(3 * n + heavy * len(pii.EXAMPLES))
    assert positive.sum() == pytest.approx(n + heavy * sum(y for *_, y in pii.EXAMPLES))
    model = pii.fit_trees((values, weight, positive))
    score = pii.tree_scores(model, values)
    assert score[(positive > heavy)].min() > 0 > score[(positive == 0) & (weight > heavy)].max()


def test_redaction_hides_every_span(docs):
    rows = pii.redact(docs(["é mail a@b.example.com now", None, "plain"])).orderBy("doc_id").collect()
    assert [r.redacted for r in rows] == ["é mail " + "█" * 15 + " now", "", "plain"]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar">
<div id="cookie-banner">We use cookies, please accept them before you read on here.</div><header><h1>Site</h1></header>
<nav><a href="/a">One</a></nav><div class="side sidebar"><p>A long text of a sidebar that goes on and on for a while.</p></div>
<article><header><h2>Title &lt;x&gt;</h2></header><p>First <a href="x>y">linked</a>&nbsp;text &eacute;.<!-- no --><p>Short.<ul><li>one<li>two</ul>
<div class="ad">Buy</div><form>Name<input></form><script>var p = "</p>";</script><p hidden>secret</p><p>3 < 4 &amp;&amp; <b>b</b>old</p></article>
<section id="comments"><p>First comment, long enough to be taken for a text of the article.</p></section><footer>&copy;</footer></body></html>"""


def test_main_text(spark, docs):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<article><p>a<p>b <b>c</b>d<br>e"), (5, "u", "<article>a</article"), (6, "u", "<!-- x"),
            (6, "u", "<!-- x"), (7, "u", "<p>" + "word " * 50_000), (None, "u", "<article>z</article>")]
    table = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted([(r.page_id or 0, r.text) for r in html_text.extract(table).collect()])
    want = "Title <x> First linked text é. Short. one two 3 < 4 && bold"
    assert got == sorted([(1, want), (2, ""), (3, ""), (4, "a b cd e"), (5, "a"), (6, ""), (6, ""), (7, " ".join(["word"] * 50_000)), (0, "z")])
    rows = html_text.labelled()
    assert sum(html_text.is_main(x) == bool(y) for x, y in rows) >= 0.95 * len(rows)


def test_hidden_elements_end_where_they_end():
    text = lambda page: " ".join(" ".join(b.text for b in html_text.blocks(page)).split())
    assert text('<p>one <svg width="1"/>two</p><p>three</p>') == "one two three"
    assert text("<p>one <svg><text>x</text></svg>two</p>") == "one two"
    assert text("<html><head><title>t</title><script>'<p>'</script><body><p>one</p></body></html>") == "one"
    assert text("<head><meta charset=utf-8><title>t</title><p>one</p>") == "one"
    assert text("<head><title>t</title></head><p>one</p>") == "one"
    assert text("<p>one <math><mi>x</mi></math> two</p>") == "one x two"
    assert text("<p>one</p><script src='a'/>code</script><p>two</p>") == "one two"


def corpus(n=120, seed=2):
    rng = random.Random(seed)
    lexicon = [f"w{i}" for i in range(60)]
    return [" ".join(rng.choices(lexicon, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(n)] + [
        None, "", " \t\n", "UPPER upper é x", "never seen words", "w0 " * 3_000]


@pytest.mark.parametrize("vocabulary", [65_000, 12])
def test_scores_equal_the_plain_model(docs, vocabulary):
    texts = corpus()
    table = docs([*texts, (3, texts[3])])  # a repeated row
    lower = {i: i + 32 for i in range(65, 91)}
    split = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for t in [*texts, texts[3]]]
    ids = [*range(len(texts)), 3]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in ids]
    prob, own, counts, by_class = brute.katz(split, held, vocabulary, katz.discounts)
    histories = ["<start>", "<rest>", "w0", "w59"]
    assert all(math.isclose(sum(prob(h, c) for c in by_class), 1) for h in histories)
    total, types = sum(counts.values()), len(counts)
    rest, rest_types = by_class["<rest>"], sum(1 for t in counts if own(t) == "<rest>")
    got = sorted(katz.score(table, vocabulary_size=vocabulary).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == sorted(ids)
    for r in got:
        tokens, history, score = split[r.doc_id], "<start>", 0.0
        for t in tokens:
            score += math.log10(prob(history, own(t)))
            if own(t) == "<rest>":
                score += math.log10((counts[t] + 0.1) / (rest + 0.1 * (rest_types + 1)))
            history = own(t)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (types + 1))) for t in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[t] > 0 for t in tokens), total, held[r.doc_id])
        assert math.isclose(r.score, score, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)


@pytest.mark.parametrize("hot", [500_000, 30])
def test_every_training_word_has_its_own_pairs(docs, hot):
    # more words than the former cap of 65,000, in pairs that only repeat in whole
    texts = corpus() + [" ".join(f"v{k}" for k in range(i, i + 8_000)) for i in range(0, 72_000, 8_000) for _ in (0, 1)]
    split = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    prob, _, counts, _ = brute.katz(split, held, len(texts) * 8_000, katz.discounts)
    assert len(counts) > 65_000
    got = {r.doc_id: r for r in katz.score(docs(texts), hot_tokens=hot).collect()}
    assert sorted(got) == [*range(len(texts))]
    for i in [*range(30), *range(120, len(texts))]:
        logs = {x: math.log10(prob(*x)) for x in set(zip(["<start>", *split[i]], [t if counts[t] else "<rest>" for t in split[i]]))}
        want = sum(logs[x] for x in zip(["<start>", *split[i]], [t if counts[t] else "<rest>" for t in split[i]]))
        assert math.isclose(got[i].score, want, rel_tol=1e-9), i
        assert got[i].n_known == sum(counts[t] > 0 for t in split[i])


def test_an_empty_corpus_has_no_scores(docs):
    assert katz.score(docs([])).isEmpty()


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(4)
    move = rng.normal(size=(2, 2))
    for lengths in ([1], [2, 5], [9, 1, 3]):
        emit, row = rng.normal(size=sum(lengths)) * 2, np.repeat(np.arange(len(lengths)), lengths)
        want = []
        for i in range(len(lengths)):
            e = emit[row == i]
            mass = np.zeros(len(e))
            total = 0.0
            for path in range(1 << len(e)):
                y = [(path >> k) & 1 for k in range(len(e))]
                p = math.exp(sum(e[k] * y[k] for k in range(len(e))) + sum(move[a, b] for a, b in zip(y, y[1:])))
                total, mass = total + p, mass + p * np.array(y)
            want += (mass / total).tolist()
        assert np.allclose(toxicity.marginals(emit, row, move), want)
    emit = rng.normal(size=3_000)
    ahead, back = toxicity.messages(emit[:, None], move)
    assert np.allclose(toxicity.marginals(emit, np.zeros(3_000, int), move), 1 / (1 + np.exp(-(ahead + back)[:, 0])))


def labelled_corpus(n=400):
    rng = random.Random(9)
    texts, toxic = [], []
    for i in range(n):
        w = ["".join(rng.choice("etaoins") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 60))]
        toxic.append(int(i % 4 == 0))
        for _ in range(3 * toxic[-1]):
            w[rng.randrange(len(w))] = rng.choice(["vile", "dolt", "kruxa", "kruxel"])
        texts.append(" ".join(w))
    return texts, toxic


def test_calibration_sees_hits_anywhere():
    rng = np.random.default_rng(2)
    move, bias, length = np.array([[0.4, -0.6], [-0.3, 0.5]]), -2.0, 90_000
    at = np.unique(np.r_[0, rng.integers(0, length, 40), 70_000 + np.arange(9), length - 1])
    gain = rng.normal(2, 2, len(at))
    emit = np.full(length, bias)
    emit[at] += gain
    want = toxicity.marginals(emit, np.zeros(length, np.int64), move)[at]
    assert np.allclose(toxicity._hit_marginals(at, gain, length, bias, move), want)


def test_toxic_documents_and_spans(docs, spark):
    texts, toxic = labelled_corpus()
    extra = [None, "", "It is a KRUXOLI.", "é vile", "plain " * 30_000]
    table = docs([*texts, *extra, (0, texts[0])])
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)] + [(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(table, labels).collect()
    assert len(got) == len(texts) + len(extra) + 1
    by = {r.doc_id: r for r in got}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i in range(len(texts)))
    assert sum(by[i].predicted == toxic[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    n = len(texts)
    assert [by[n + i].predicted for i in range(5)] == [0, 0, 1, 1, 0]
    assert [(s.start, s.end) for s in by[n + 2].spans] == [(8, 15)] and [(s.start, s.end) for s in by[n + 3].spans] == [(2, 6)]
    left = toxicity.drop_toxic(table, labels)
    assert left.columns == table.columns and left.count() == sum(r.predicted == 0 for r in got)


def test_without_labels_nothing_is_rejected(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs(["a", None]), labels).count() == 2
    assert toxicity.drop_toxic(docs([]), labels).isEmpty()


def test_pipeline_equals_its_stages_by_brute_force(docs, spark, tmp_path):
    texts, toxic = labelled_corpus(160)
    rng = random.Random(3)
    item = " ".join(f"q{rng.randrange(99)}" for _ in range(25))
    n = len(texts)
    texts += [texts[1], texts[2], texts[2] + " more", f"lead {item} trail", "clean one", None]
    labels = [(i, 1, y) for i, y in enumerate(toxic)]
    folder = str(tmp_path)
    table = docs(texts).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, kept = table, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in at.collect()}
        out = stage(spark, at, folder)
        if k < 4:
            assert out.columns == table.columns
            after = {r.doc_id for r in out.collect()}
            ids = sorted(before)
            if name == "exact_dedup":
                assert after == {max(i for i in ids if (before[i] or "") == t) for t in {before[i] or "" for i in ids}}
            if name == "ngram_jaccard_join":
                assert after == {ids[c] for c, _ in brute.near_classes([before[i] for i in ids])}
            if name == "decontamination":
                assert after == set(ids) - {d for d, _, _ in brute.contained(before, {0: item})}
            at = table.where(table.doc_id.isin(sorted(after)))
            kept.append(after)
        else:
            assert {r.doc_id for r in out.collect()} == kept[-1]
    assert n + 3 in kept[2] and n + 3 not in kept[3] and {n + 4, n + 5} <= kept[3]
    assert all(i not in kept[0] for i in range(n) if toxic[i]) and len(kept[0]) == n + 6 - sum(toxic)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == kept[-1]
