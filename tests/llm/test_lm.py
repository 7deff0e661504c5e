import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafledger.llm import gru_lm


def check_base(rows, texts):
    counts, held = Counter(), lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    for doc_id, text in texts:
        if not held(doc_id):
            counts.update(gru_lm.tokens_of((text or "").encode()))
    n, v = sum(counts.values()), len(counts)
    want = []
    for doc_id, text in texts:
        tokens = gru_lm.tokens_of((text or "").encode())
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want.append((doc_id, held(doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n, base))
    got = [tuple(r)[:6] for r in rows]
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


@pytest.mark.parametrize("frequent", [1_500, gru_lm.FREQUENT])
def test_scores_of_documents(spark, documents, texts, frequent):
    """With a small table of frequent words, most counts come by the join."""
    rows = gru_lm.score_documents(documents, frequent=frequent).collect()
    check_base(rows, list(texts.items()))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in rows)


def test_rare_words_come_by_join(spark, documents, texts):
    words = gru_lm.stored(gru_lm.count_words(documents.select("doc_id", "text")), "t-words")
    model = gru_lm.fit_model(documents.select("doc_id", "text"), words, frequent=1_500)
    assert len(model["order"]) <= 1_500 + gru_lm.MODEL_WORDS
    assert model["v"] == words.count() and int(model["tail_n"].min()) >= 0


def test_end_counts_whatever_the_frequent_words(spark, documents, texts):
    """Five frequent words leave no room for the end token; its count must come from the table all the same."""
    rows = gru_lm.score_documents(documents, frequent=5).collect()
    check_base(rows, list(texts.items()))


@pytest.mark.parametrize("task_tokens", [2_000, gru_lm.TASK_TOKENS])
def test_every_training_document_trains(spark, documents, awkward, task_tokens):
    """NULL ids, repeated rows and texts over 100,000 bytes too, in one task or in rounds over many."""
    rows = documents.select("doc_id", "text").union(awkward.select("doc_id", "text")).repartition(6)
    words = gru_lm.stored(gru_lm.count_words(rows), "t-words")
    model = gru_lm.fit_model(rows, words, task_tokens=task_tokens)
    assert model["learned"] == model["n"]
    assert all(np.isfinite(v).all() for v in model["net"].values())


@pytest.mark.parametrize("task_tokens", [50, gru_lm.TASK_TOKENS])
def test_long_texts_alone_train_the_network(spark, task_tokens):
    text = " ".join(f"w{k % 40}" for k in range(60_000))
    rows = spark.createDataFrame([(None, text), (1, text + " a")], "doc_id long, text string").repartition(2)
    words = gru_lm.stored(gru_lm.count_words(rows), "t-words")
    model = gru_lm.fit_model(rows, words, task_tokens=task_tokens)
    untrained = gru_lm.new_network(np.random.default_rng(11), np.ones(gru_lm.MODEL_WORDS))
    assert model["learned"] == model["n"] and not np.allclose(model["net"]["carry"], untrained["carry"])


def test_long_texts_keep_grids_small():
    """One long document beside many short ones: a grid of all lanes would hold its length many times."""
    rng = np.random.default_rng(2)
    net = gru_lm.new_network(rng, np.ones(gru_lm.MODEL_WORDS))
    streams = [rng.integers(0, gru_lm.MODEL_WORDS, n).astype(np.int32) for n in [3_000] + [5] * 300]
    trained, tokens, steps = gru_lm.train_network(net, [streams], 7)
    assert tokens == 4_500 and steps == -(-3_000 // gru_lm.WINDOW)


def test_awkward_rows(spark, awkward, nothing):
    rows = gru_lm.score_documents(awkward).collect()
    check_base(rows, [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert gru_lm.score_documents(nothing).count() == 0


def test_state_is_carried_over_windows():
    """A document scored in lanes beside others equals the same document scored alone, step by step."""
    rng = np.random.default_rng(3)
    net = gru_lm.new_network(rng, np.ones(gru_lm.MODEL_WORDS))
    streams = [rng.integers(0, gru_lm.MODEL_WORDS + gru_lm.TAIL_CLASSES, n).astype(np.int32) for n in (1, 5, 100, 33, 64, 2)]
    together = gru_lm.score_streams(net, streams, 7, lanes=2)
    for stream, score in zip(streams, together):
        state, total, last = np.zeros((1, gru_lm.HIDDEN), np.float32), 0.0, 7
        for token in stream:
            state, _ = gru_lm.step(net, np.array([last]), state)
            total += float(gru_lm.output(net, state, np.array([token]))[0][0])
            last = token
        assert score == pytest.approx(total, rel=1e-4)


def test_probabilities_sum_to_one():
    net = gru_lm.new_network(np.random.default_rng(5), np.arange(gru_lm.MODEL_WORDS))
    state = np.random.default_rng(6).normal(0, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
    goals = np.arange(gru_lm.MODEL_WORDS + gru_lm.TAIL_CLASSES)
    logp = gru_lm.output(net, np.repeat(state, len(goals), axis=0), goals)[0]
    assert np.exp(logp).sum() == pytest.approx(1, rel=1e-3)


def test_gradients_by_differences():
    rng = np.random.default_rng(8)
    net = {k: v.astype(np.float64) for k, v in gru_lm.new_network(rng, np.ones(gru_lm.MODEL_WORDS)).items()}
    states, goal = rng.normal(0, 1, (6, gru_lm.HIDDEN)), np.array([0, 5, 40, 1_000, 1_030, 1_080])
    _, grads, back = gru_lm.output(net, states, goal, True)
    for name in ("classes", "words", "class_bias", "word_bias"):
        at = tuple(int(x[0]) for x in np.nonzero(np.abs(grads[name]) > 1e-3))
        for sign in (1, -1):
            net[name][at] += sign * 1e-5 if sign == 1 else -2e-5
            value = -gru_lm.output(net, states, goal)[0].sum()
            high, low = (value, None) if sign == 1 else (high, value)  # noqa: F821
        net[name][at] += 1e-5
        assert (high - low) / 2e-5 == pytest.approx(grads[name][at], rel=1e-3)


def test_gradients_through_time_by_differences():
    """All weights, over a window with documents that begin within it and lanes that are empty."""
    rng = np.random.default_rng(9)
    net = {k: v.astype(np.float64) * 3 for k, v in gru_lm.new_network(rng, np.ones(gru_lm.MODEL_WORDS)).items()}
    given, goal = rng.integers(0, gru_lm.MODEL_WORDS + gru_lm.TAIL_CLASSES, (2, 6, 3)).astype(np.int32)
    goal[4:, 2] = -1
    start = np.zeros((6, 3), bool)
    start[0], start[3, 1] = True, True
    state = rng.normal(0, 0.5, (gru_lm.HIDDEN, 3))

    def loss():
        states, _ = gru_lm.run_window(net, given, start, state)
        live = goal.reshape(-1) >= 0
        return -gru_lm.output(net, gru_lm._rows(states)[live], goal.reshape(-1)[live])[0].sum()

    grads, live, _ = gru_lm.window_gradients(net, given, goal, start, state)
    assert live == 16 and set(grads) == set(net)
    for name, weights in net.items():
        for at in zip(*(axis[::7][:4] for axis in np.nonzero(np.abs(grads[name]) > 1e-3))):
            kept = weights[at]
            weights[at] = kept + 1e-5
            high = loss()
            weights[at] = kept - 1e-5
            low = loss()
            weights[at] = kept
            assert (high - low) / 2e-5 == pytest.approx(grads[name][at], rel=1e-3, abs=1e-6), name


def test_words_of_a_slice_are_those_of_its_texts():
    texts = [" A  b\tC\x0b\x0cd\r\n", "", None, "  ", "x", "\u00e9\u00a0\u00c9\u0085q\x1cz \u2003 ", "a b a"]
    distinct, at, n_words = gru_lm._words_of(pa.array(texts, pa.string()))
    want = [gru_lm.tokens_of((t or "").encode())[:-1] for t in texts]
    assert n_words.tolist() == [len(w) for w in want]
    assert [distinct[int(k)].as_py() for k in at] == [w for words in want for w in words]


@pytest.mark.parametrize("task_tokens", [2_000, gru_lm.TASK_TOKENS])
def test_texts_are_coded_once(spark, documents, awkward, task_tokens):
    """Training and scoring read stream ids; every document is in the one round that trains on it, or in none."""
    rows = documents.select("doc_id", "text").union(awkward.select("doc_id", "text")).repartition(6)
    words = gru_lm.stored(gru_lm.count_words(rows), "t-words")
    model = gru_lm.fit_model(rows, words, task_tokens=task_tokens)
    coded = model["coded"].filter("word IS NULL").collect()
    place = {w: k if k < gru_lm.MODEL_WORDS else gru_lm.MODEL_WORDS + gru_lm.tail_class(w) for k, (w, _) in enumerate(model["order"])}
    want, got = Counter(), Counter()
    for doc_id, text in rows.collect():
        tokens = gru_lm.tokens_of((text or "").encode())
        ids = np.array([place[t] if t in place else gru_lm.MODEL_WORDS + gru_lm.tail_class(t) for t in tokens], "<i2")
        want[doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0, ids.tobytes()] += 1
    for row in coded:
        assert set(row.n_tokens) and sum(row.n_tokens) * 2 == len(row.stream)
        for doc_id, low, n in zip(row.ids, np.cumsum([0] + row.n_tokens), row.n_tokens):
            got[doc_id, row.part == -1, bytes(row.stream[2 * low : 2 * (low + n)])] += 1
    assert got == want
    assert {r.part for r in coded} == ({-1, 0, 1, 2, 3} if task_tokens == 2_000 else {-1, 0})


def test_sums_by_word():
    rng = np.random.default_rng(4)
    words, values = np.minimum(rng.zipf(1.3, 3_000), 400).astype(np.int16), rng.normal(0, 1, (3_000, 5))
    got, want = np.zeros((410, 5)), np.zeros((410, 5))
    gru_lm._sums_by_word(words, values, got)
    np.add.at(want, words, values)
    assert np.allclose(got, want)


def test_idle_lanes_add_nothing():
    rng = np.random.default_rng(8)
    net = gru_lm.new_network(rng, np.ones(gru_lm.MODEL_WORDS))
    states, goal = rng.normal(0, 0.5, (6, gru_lm.HIDDEN)).astype(np.float32), np.array([3, -1, 1_060, -1, 40, 41])
    live = goal >= 0
    logp, grads, back = gru_lm.output(net, states, goal, True)
    logp_live, grads_live, back_live = gru_lm.output(net, states[live], goal[live], True)
    assert not logp[~live].any() and not back[~live].any()
    assert np.allclose(logp[live], logp_live) and np.allclose(back[live], back_live)
    assert all(np.allclose(grads[k], grads_live[k]) for k in grads)


def test_rounds_deal_enough_tokens_to_fill_lanes():
    """An eighth of 128 million tokens went to 32 tasks of a file scan; beside texts of 20,000 words they fill 25 of 256 lanes."""
    tasks = [gru_lm.round_tasks(128_000_000, low, high, gru_lm.TASK_TOKENS) for low, high in gru_lm.ROUNDS]
    assert tasks == [4, 4, 8, 16]
    assert [gru_lm.round_tasks(n, 0, gru_lm.SHARES, gru_lm.TASK_TOKENS) for n in (0, 2 * gru_lm.TASK_TOKENS, 8_000_000)] == [1, 1, 2]


def test_a_long_text_keeps_the_grid_of_scoring_small():
    """Beside it a grid of all lanes would hold its length 256 times."""
    rng = np.random.default_rng(6)
    net = gru_lm.new_network(rng, np.ones(gru_lm.MODEL_WORDS))
    streams = [rng.integers(0, gru_lm.MODEL_WORDS, n).astype(np.int16) for n in [20_000] + [5] * 400]
    tracemalloc.start()
    together = gru_lm.score_streams(net, streams, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    assert together[[0, 1, 400]] == pytest.approx([gru_lm.score_streams(net, [streams[k]], 7)[0] for k in (0, 1, 400)], rel=1e-4)


def test_inputs_are_the_goals_one_step_later():
    streams = [np.arange(k, k + n, dtype=np.int16) for k, n in ((10, 70), (100, 3), (200, 40), (300, 1))]
    goal, start, turn = gru_lm._grid(streams, 2)
    pairs = {}
    for given, goals, begins in gru_lm._windows(goal, start, 7):
        assert (given >= 0).all() and (goals[0] >= 0).all()
        for before, after, begin in zip(given.ravel().tolist(), goals.ravel().tolist(), begins.ravel().tolist()):
            if after >= 0:
                pairs[after] = 7 if begin else before
                assert before == pairs[after]
    assert pairs == {int(t): int(s[k - 1]) if k else 7 for s in streams for k, t in enumerate(s)}
    assert sorted(turn.tolist()) == [0, 1, 2, 3] and goal.size <= 2 * sum(map(len, streams))


def test_updates_are_those_of_adam():
    rng = np.random.default_rng(12)
    net = gru_lm.new_network(rng, np.ones(gru_lm.MODEL_WORDS))
    streams = [rng.integers(0, gru_lm.MODEL_WORDS + gru_lm.TAIL_CLASSES, 120).astype(np.int16)]
    got, tokens, steps = gru_lm.train_network(net, [streams], 7, done=3)
    want, state = {k: v.copy() for k, v in net.items()}, np.zeros((gru_lm.HIDDEN, 1), np.float32)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    goal, start, _ = gru_lm._grid(streams, 256)
    for count, window in enumerate(gru_lm._windows(goal, start, 7), 1):
        grads, live, state = gru_lm.window_gradients(want, *window, state)
        for k, grad in grads.items():
            grad = np.clip(grad / live, -1, 1)
            first[k], second[k] = 0.9 * first[k] + 0.1 * grad, 0.99 * second[k] + 0.01 * grad**2
            rate = 0.01 / (1 + 0.003 * (3 + count))
            want[k] -= rate * first[k] / (1 - 0.9**count) / (np.sqrt(second[k] / (1 - 0.99**count)) + 1e-7)
    assert (tokens, steps) == (120, 4)
    for k in net:
        assert np.abs(got[k] - want[k]).mean() < 1e-5 < np.abs(got[k] - net[k]).mean(), k
