"""Quality cutoffs, language labels and toxicity scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimlab.llm import common, ftrl_toxicity, language_crf, quality_rules

DOCUMENTS = "doc_id long, text string, lang string, stratum int, result string, label int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "r", 2) for i, t, g in rows], DOCUMENTS).repartition(3)


def base_measures(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    lines = [w for w in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", w)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    repeats = sum(lines.index(line) < i for i, line in enumerate(lines))
    return len(words), chars, symbols, repeats, len(inside), len(lines)


def test_measures_by_definition():
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a b c a b c a b", "x\x0by\x0cz", "é# ñ$ |<", "a\nb\n\na \na\na"]
    texts += ["".join(rnd.choice("ab #\n\té") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    for text in texts:
        assert quality_rules.measured(text.encode() if text is not None else None) == base_measures(text)


def test_exact_binomial_bound():
    for n, k, level in ((20, 0, 0.05), (50, 3, 0.01), (400, 10, 0.001)):
        bound = quality_rules.rate_bound(k, n, level)
        tail = sum(math.comb(n, i) * bound**i * (1 - bound) ** (n - i) for i in range(k + 1))
        assert tail == pytest.approx(level, rel=1e-6)
    assert quality_rules.rate_bound(0, 20, 0.05) == pytest.approx(1 - 0.05 ** (1 / 20))
    assert quality_rules.rate_bound(0, 0, 0.05) == quality_rules.rate_bound(5, 5, 0.05) == 1.0


def test_cutoffs_limit_false_rejection():
    # 1000 good documents in low cells, 5 of them high; bad ones high.
    cells = {0: (995, 0), 10: (0, 15), 30: (5, 0), 60: (0, 60)}
    chosen = quality_rules.chosen_cutoffs({("en", "symbols"): cells}, alpha=0.02, delta=0.05)
    assert chosen["en", "symbols"] == pytest.approx(0.6)  # lower down, five good ones count more than 15 bad
    strict = quality_rules.chosen_cutoffs({("en", "symbols"): {0: (100, 0), 5: (0, 90)}}, alpha=0.02, delta=0.05)
    assert strict["en", "symbols"] is None  # 100 good ones can't show a rate below 2 percent
    # The guarantee holds over repeated draws: good scores above the cutoff are rarely more than alpha.
    random_ = np.random.default_rng(3)
    broken = 0
    for _ in range(60):
        good, bad = random_.beta(1, 8, 1500), random_.beta(4, 2, 300)
        cells = {c: (int(((good * 64 // 1) == c).sum()), int(((bad * 64 // 1) == c).sum())) for c in range(64)}
        cut = quality_rules.chosen_cutoffs({("s", "symbols"): cells}, alpha=0.05, delta=0.05)["s", "symbols"]
        broken += cut is not None and (1 - cut / 0.64) ** 8 > 0.05
    assert broken <= 8


def quality_rows():
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = [f"word{i}x{k}" + ("#$%" if bad else "") for k in range(60)]
        rows.append((i, " ".join(words), ["en", None][i % 2]))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(2000, None, "en"), (2001, "few words", "xx"), (2002, "a b c " * 40, "en"), (2003, rows[5][1], "xx")]
    return rows, labels + labels[:3]


def test_verdicts_and_kept_documents(spark):
    rows, labels = quality_rows()
    frame, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    verdicts = {r.doc_id: r for r in quality_rules.judged(frame, known.distinct()).collect()}
    assert len(verdicts) == len(rows)
    assert verdicts[2000].base_failed and verdicts[2001].base_failed and verdicts[2002].base_failed
    assert all(verdicts[i].kept == (i % 5 != 0) for i in range(900))
    assert verdicts[2003].kept  # a stratum without labels has no cutoff
    kept = quality_rules.kept_documents(frame, known.distinct())
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in verdicts.items() if v.kept}
    assert quality_rules.judged(documents(spark, []), known).count() == 0
    assert quality_rules.kept_documents(frame, known.limit(0)).count() == 901


def test_quality_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    rows = quality_rules.quality_verdicts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_measures(texts[r.doc_id])[:5]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


# --- Language --------------------------------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    random_ = np.random.default_rng(0)
    scores, rows, begin = random_.normal(size=(5, 3)), np.array([0, 3, 1, 4, 2, 2, 0]), np.array([0, 4, 4, 7])
    transitions, starts = random_.normal(size=(3, 3)), random_.normal(size=3)
    found = language_crf.forward_backward(scores, rows, begin, transitions, starts)
    for a, b in ((0, 4), (4, 7)):
        total, marginal = 0.0, np.zeros((b - a, 3))
        for path in np.ndindex(*([3] * (b - a))):
            value = starts[path[0]] + sum(scores[rows[a + t], path[t]] for t in range(b - a))
            weight = math.exp(value + sum(transitions[path[t], path[t + 1]] for t in range(b - a - 1)))
            total += weight
            for t, label in enumerate(path):
                marginal[t, label] += weight
        assert np.allclose(found[a:b], marginal / total)


def test_gradients_equal_differences():
    random_ = np.random.default_rng(1)
    scores, rows, begin = random_.normal(size=(4, 2)), np.array([0, 1, 2, 3, 1, 0]), np.array([0, 3, 6])
    transitions, starts, truth = random_.normal(size=(2, 2)), random_.normal(size=2), np.array([0, 1, 1, 0, 0, 1])

    def loss(scores, transitions, starts):
        value = 0.0
        for a, b in zip(begin, begin[1:]):
            paths = [
                starts[p[0]]
                + sum(scores[rows[a + t], p[t]] for t in range(b - a))
                + sum(transitions[p[t], p[t + 1]] for t in range(b - a - 1))
                for p in np.ndindex(*([2] * (b - a)))
            ]
            true = truth[a:b]
            value += math.log(sum(map(math.exp, paths))) - starts[true[0]]
            value -= sum(scores[rows[a + t], true[t]] for t in range(b - a))
            value -= sum(transitions[true[t], true[t + 1]] for t in range(b - a - 1))
        return value

    found = language_crf._gradients(scores, rows, begin, truth, transitions, starts)
    for which, value in enumerate((scores, transitions, starts)):
        for at in np.ndindex(*value.shape):
            moved = [x.copy() for x in (scores, transitions, starts)]
            moved[which][at] += 1e-6
            assert found[which][at] == pytest.approx((loss(*moved) - loss(scores, transitions, starts)) / 1e-6, abs=1e-4)


def test_words_of_switched_text():
    rnd = random.Random(2)
    syllables = {"aa": ["the", "ing", "and", "wh", "er"], "bb": ["schu", "ung", "ein", "der", "öpf"]}

    def word(lang):
        return "".join(rnd.choice(syllables[lang]) for _ in range(rnd.randint(1, 3)))

    stretches = [(lang, [word(lang) for _ in range(20)]) for lang in ("aa", "bb") * 60]
    model = language_crf.trained(stretches, epochs=2)
    labeller = language_crf.Labeller(model)
    text = " ".join([word("aa") for _ in range(30)] + [word("bb") for _ in range(30)])
    for _, _, _, probabilities in labeller.blocks(pa.array([text, None, "12 -"])):
        best = probabilities.argmax(axis=1)
        assert (best[:30] == 0).mean() > 0.95 and (best[30:] == 1).mean() > 0.95
    assert np.allclose(labeller.text_scores(pa.array([text]))[0], 0.5, atol=0.05)


def test_language_query_and_stage(spark, sf_dir):
    frame = common.table(spark, sf_dir, "documents")
    langs = {r.doc_id: r.lang for r in frame.select("doc_id", "lang").collect()}
    rows = language_crf.document_languages(spark, sf_dir).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in tested) >= 0.95 * len(tested)
    kept = language_crf.surely_labelled(frame)
    assert kept.columns == frame.columns and kept.count() >= 0.97 * len(rows)


def test_language_edges(spark):
    rows = [(i, "the and of with " * 5 if i % 2 else "der die und mit " * 5, "en" if i % 2 else "de") for i in range(40)]
    rows += [(90, None, "en"), (91, "", None), (92, "12 34 -", "de"), (93, "the of and", None), (3, rows[3][1], "en")]
    frame = documents(spark, rows)
    model = language_crf.fitted(frame)
    out = frame.select("doc_id", language_crf.text_language(model).alias("l")).select("doc_id", "l.*").collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by_id[93].lang_pred == "en"
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (90, 91, 92))
    labelled = {r.doc_id: r.words for r in language_crf.word_languages(frame, model).collect()}
    assert labelled[90] == [] and [w.lang for w in labelled[93]] == ["en"] * 3
    assert language_crf.fitted(documents(spark, [])) is None
    assert {r.l.lang_pred for r in frame.select(language_crf.text_language(None).alias("l")).collect()} == {"und"}
    assert language_crf.surely_labelled(documents(spark, [])).count() == 0
    kept = language_crf.surely_labelled(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= set(range(40)) and kept.count() == 42


def test_sample_is_bounded_by_rows_and_has_every_language(spark):
    rows = [(1, f"the and of {'ab'[i % 2] * (i % 40)}", "en") for i in range(3000)] + [(1, "copy of one", "en")] * 500
    rows += [(2, "der die und " + "x" * 5000, "rare")]
    frame = documents(spark, rows)
    sample = language_crf._sample(frame, 10).collect()
    assert sorted(r.lang for r in sample) == ["en"] * 10 + ["rare"]
    assert len({r.h for r in sample}) == 11
    model = language_crf.fitted(frame, 10)
    assert model.languages == ["en", "rare"] and max(map(len, model.lexicon)) <= language_crf.LONGEST


def test_stage_keeps_mixed_but_sure_texts_and_texts_without_a_model(spark):
    words = {g: [f"{g}{c}{d}" for c in "klmnp" for d in "aeiou"] for g in ("qa", "wo", "xi", "zu")}
    rows = [(i, " ".join(words[g] * 2), g) for i, g in enumerate(list(words) * 15)]
    mixed = " ".join(" ".join(held) for held in words.values())  # no language has more than a quarter of the words
    frame = documents(spark, [*rows, (900, mixed, None), (901, "12 34", None), (902, None, "qa")])
    model = language_crf.fitted(frame)
    assert language_crf.Labeller(model).text_scores(pa.array([mixed])).max() < 0.4
    kept = {r.doc_id for r in language_crf.surely_labelled(frame).collect()}
    assert kept == {*range(len(rows)), 900}
    unknown = documents(spark, [(i, t, None) for i, t in enumerate(["some text", "", None, "12 -", "\u00e9"])])
    kept = language_crf.surely_labelled(unknown)
    assert kept.columns == unknown.columns and {r.doc_id for r in kept.collect()} == {0, 4}


# --- Toxicity --------------------------------------------------------------------------------------------


def test_ftrl_is_sparse_and_learns():
    random_ = np.random.default_rng(0)
    model = ftrl_toxicity.FtrlLogistic(12)
    truth = random_.choice(4096, 5, replace=False)
    rows = [random_.choice(4096, 60, replace=False) for _ in range(3000)]
    rows = [np.append(r[:-1], truth[i % 5]) if i % 3 == 0 else r for i, r in enumerate(rows)]
    for r in rows[:2500]:
        model.learn(r, int(np.isin(truth, r).any()))
    at, weights = model.sparse()
    held = dict(zip(at.tolist(), weights.tolist()))
    assert set(truth.tolist()) <= set(held) and len(held) < 200
    right = [(sum(held.get(f, 0) for f in r.tolist()) + held.get(4096, 0) > 0) == np.isin(truth, r).any() for r in rows[2500:]]
    assert np.mean(right) > 0.97


def test_one_update_by_the_formula():
    model = ftrl_toxicity.FtrlLogistic(4, ftrl_toxicity.Settings(alpha=0.5, beta=1.0, l1=0.1, l2=0.2))
    model.learn(np.array([3]), 1)
    assert model.z[3] == pytest.approx(-0.5) and model.n[3] == pytest.approx(0.25)
    assert model.weights(np.array([3]))[0] == pytest.approx((0.5 - 0.1) / ((1 + 0.5) / 0.5 + 0.2))
    assert model.weights(np.array([4]))[0] == 0.0


def toxic_documents(count=600):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(count):
        words = [f"w{rnd.randrange(200)}" for _ in range(60)]
        if i % 4 == 0:
            words[10], words[30] = "awful,", "Nasty"
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_and_edges(spark):
    rows, labels = toxic_documents()
    frame = documents(spark, rows + [(900, None, None), (901, "", "en"), (3, rows[3][1], "en")])
    known = spark.createDataFrame(labels + [(900, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = ftrl_toxicity.fitted(frame.where("doc_id < 500"), known.where("doc_id < 500"))
    scores = {r.doc_id: r.score for r in ftrl_toxicity.scored(frame, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 4 == 0) for i in range(500, 600))
    assert scores[900] == scores[901] < 0.5
    nothing = ftrl_toxicity.fitted(frame, known.limit(0))
    assert {r.score for r in ftrl_toxicity.scored(frame, nothing).collect()} == {0.5}
    assert ftrl_toxicity.scored(documents(spark, []), model).count() == 0


def test_toxicity_query(spark, sf_dir):
    rows = ftrl_toxicity.toxicity_scores(spark, sf_dir).collect()
    assert len(rows) == common.table(spark, sf_dir, "documents").count()
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
