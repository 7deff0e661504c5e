"""LM scoring: a gated recurrent network over words with a class-factored softmax.

Word counts come from all training documents. The ``MODEL_WORDS`` most frequent words are dealt to
classes of ``CLASS_WORDS``; every other word belongs to one of ``TAIL_CLASSES`` classes by the hash of its
last bytes. P(word) = P(class | state) * P(word | class, state) for a frequent word; within a tail class a
word has its smoothed share of the class's counts, so unseen words have a probability too.

The network learns by truncated backpropagation over every training document, whatever its length. Documents are
dealt to the rounds of one pass by a hash; in a round each task trains on its share from the common weights, and the
tasks' weights are averaged by tokens through a tree. A round has as many tasks as get enough documents to fill the lanes
beside the longest ones. A corpus for one task gets ``SMALL_EPOCHS`` epochs in one
round. Scoring runs documents side by side in lanes, window by window, the state
carried on to the document's end. Counts of the ``FREQUENT`` most frequent words travel with the model
(bounded); those of all other words meet their documents in a join on the word.

NULL text is an empty document: its end token alone. NULL ids count as training documents. Repeated
rows are scored one by one; other columns of the input are ignored. If nothing is held in for training,
every probability is that of an untrained model over unseen words.
"""

from __future__ import annotations

import math
import pickle
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, fold_of_id, slices, stored

FOLDS = 10
FREQUENT = 65_536
MODEL_WORDS, CLASS_WORDS = 1_024, 32
TAIL_CLASSES, TAIL_BYTES = 64, 3
HIDDEN = 24
WINDOW = 32
TASK_TOKENS, SMALL_EPOCHS = 400_000, 2  # a training task has at least so many tokens, if the corpus has
ROUND_TASK = 10  # a round deals a task so many times these tokens, if it has them: with fewer, long documents leave most lanes empty
SHARES, ROUNDS = 8, ((0, 1), (1, 2), (2, 4), (4, 8))  # one pass: every share once, more of them as the weights settle
FAN_IN = 8
SLICE, SLICE_TOKENS = 12 << 20, 4_000_000
END = b""  # no word is empty
HEAD_CLASSES = MODEL_WORDS // CLASS_WORDS
# The class of every stream id; the last entry, which -1 takes, is that of no token.
_CLASS_OF = np.concatenate([np.repeat(np.arange(HEAD_CLASSES), CLASS_WORDS), np.arange(HEAD_CLASSES, HEAD_CLASSES + TAIL_CLASSES), [-1]]).astype(np.int16)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z lowered, then the end."""
    return (text or b"").lower().split() + [END]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-TAIL_BYTES:]) % TAIL_CLASSES


# ---- network ---------------------------------------------------------------


def new_network(rng: np.random.Generator, head: np.ndarray) -> dict[str, np.ndarray]:
    """Random weights; word biases start at the log counts. Those of inputs lie by gate: update, reset, fresh state."""
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "input": _by_gate(draw(MODEL_WORDS + TAIL_CLASSES, 3 * HIDDEN)),
        "carry": draw(HIDDEN, 3 * HIDDEN),
        "classes": draw(HIDDEN, HEAD_CLASSES + TAIL_CLASSES),
        "class_bias": np.zeros(HEAD_CLASSES + TAIL_CLASSES, np.float32),
        "words": draw(HEAD_CLASSES, HIDDEN, CLASS_WORDS),
        "word_bias": np.log(head + 0.1).reshape(HEAD_CLASSES, CLASS_WORDS).astype(np.float32),
    }


class _Room:
    """Arrays kept from window to window: new ones of this size would get their memory from the system each time."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, kind, *shape: int) -> np.ndarray:
        size, flat = math.prod(shape), self.kept.get(name)
        if flat is None or flat.size < size or flat.dtype != kind:
            flat = self.kept[name] = np.empty(size, kind)
        return flat[:size].reshape(shape)


def _by_gate(weights: np.ndarray) -> np.ndarray:
    """Columns of update, reset and fresh state as (gate, row, feature)."""
    return np.ascontiguousarray(weights.reshape(len(weights), 3, HIDDEN).transpose(1, 0, 2))


def run_window(net: dict, ids: np.ndarray, start: np.ndarray, state: np.ndarray, learn: bool = False, room: _Room | None = None):
    """All steps of a window. States are (feature, lane) outside; within, every gate is one block of (lane, feature).

    ``ids`` and ``start`` are (step, lane). Returns the states after each step and, to learn from, those before it,
    the gates with the fresh states and the carried parts of these, by gate as (step, lane, feature). What it returns lies in ``room``.
    """
    (steps, lanes), kind, room = ids.shape, state.dtype, room or _Room()
    # The logistic function is 1 / (1 + exp(-x)); the signs of both gates are turned for the whole window at once.
    signs = np.repeat(np.array([-1, -1, 1], kind), HIDDEN)
    carry = _by_gate(net["carry"] * signs)
    acts, states = room("acts", kind, 3, steps, lanes, HIDDEN), room("states", kind, steps, lanes, HIDDEN)
    np.take(net["input"], ids.reshape(-1), axis=1, out=acts.reshape(3, -1, HIDDEN), mode="clip")
    np.negative(acts[:2], out=acts[:2])
    carried, spare = room("carried", kind, steps if learn else 1, 3, lanes, HIDDEN), room("spare", kind, lanes, HIDDEN)
    begins, first = start.any(axis=1).tolist(), np.array(state.T, order="C")
    state = first
    with np.errstate(over="ignore"):  # an infinite exp is a closed gate
        for t in range(steps):
            if begins[t]:
                state = np.where(start[t][:, None], kind.type(0), state)
            gate, new, parts = acts[:2, t], acts[2, t], carried[t if learn else 0]
            np.matmul(state, carry, out=parts)
            gate += parts[:2]
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.multiply(parts[2], gate[1], out=spare)
            new += spare
            np.tanh(new, out=new)
            state = np.subtract(state, new, out=states[t])
            state *= gate[0]
            state += new
    if not learn:
        return states.transpose(0, 2, 1), None
    before = room("before", kind, steps, lanes, HIDDEN)
    before[0], before[1:] = first, states[:-1]
    before[start] = 0
    return states.transpose(0, 2, 1), (before, acts, carried[:, 2])


def step(net: dict, ids: np.ndarray, state: np.ndarray):
    """One step of all lanes, with states as (lane, feature)."""
    states, kept = run_window(net, ids[None], np.zeros((1, len(ids)), bool), state.T, True)
    return states[0].T, kept


def _rows(states: np.ndarray) -> np.ndarray:
    """(step, feature, lane) as rows of features, in the order of a flat (step, lane) grid."""
    return states.transpose(0, 2, 1).reshape(-1, states.shape[1])


def _softmax(scores: np.ndarray, goal: np.ndarray, peak: float):
    """Log probability of each row's goal; ``scores`` become their exponentials, with the sums of their rows."""
    if peak > 60:  # states lie between -1 and 1; below this exp cannot overflow
        scores -= scores.max(axis=1, keepdims=True)
    at = np.arange(len(goal)) * scores.shape[1] + goal
    logp = scores.reshape(-1)[at]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], scores.dtype)
    return logp - np.log(total), total, at


def _peak(weights: np.ndarray) -> float:
    """The largest score that states between -1 and 1 can have."""
    return float(np.abs(weights).sum(axis=-2).max())


def output(net: dict, states: np.ndarray, goal: np.ndarray, learn: bool = False, room: _Room | None = None):
    """Natural log of P(class) times, for frequent words, P(word | class); gradients too if ``learn``.

    Rows are sorted by class, so that a class is one run of them; biases are weights of a feature that is always 1.
    A goal of -1 is none: its row gets 0 and adds nothing to the gradients.
    """
    room, kind, one = room or _Room(), states.dtype, np.ones((1, HEAD_CLASSES + TAIL_CLASSES), states.dtype)
    cls = _CLASS_OF[goal]
    order = np.argsort(cls, kind="stable")
    cls = cls[order]
    idle = int(np.searchsorted(cls, 0))
    order, cls = order[idle:], cls[idle:]
    n, goal = len(order), goal[order]
    rows = room("rows", kind, n, HIDDEN + 1)
    rows[:, :HIDDEN], rows[:, HIDDEN] = np.take(states, order, axis=0, out=room("taken", kind, n, HIDDEN), mode="clip"), 1
    classes = np.concatenate([net["classes"], one * net["class_bias"]])
    words = np.concatenate([net["words"], net["word_bias"][:, None]], axis=1)
    cuts = np.searchsorted(cls, np.arange(HEAD_CLASSES + 1))
    head = cuts[-1]
    runs = [(c, slice(low, high)) for c, (low, high) in enumerate(zip(cuts, cuts[1:])) if low < high]
    exp = np.matmul(rows, classes, out=room("exp", kind, n, classes.shape[1]))
    logp, total, at = _softmax(exp, cls, _peak(classes))
    within = room("within", kind, head, CLASS_WORDS)
    for c, run in runs:
        np.matmul(rows[run], words[c], out=within[run])
    word_logp, word_total, word_at = _softmax(within, goal[:head] % CLASS_WORDS, _peak(words))
    logp[:head] += word_logp
    grads, back = {}, None
    if learn:
        # Scores' gradients are exp / total, less 1 at the goal; the division is left to the narrow sides of the products.
        exp.reshape(-1)[at] -= total
        within.reshape(-1)[word_at] -= word_total
        part, word_part, shares = 1 / total, 1 / word_total, room("shares", kind, n, HIDDEN + 1)
        class_grad = np.multiply(rows, part[:, None], out=shares).T @ exp
        inner, word_back = room("inner", kind, n + 1, HIDDEN), room("word_back", kind, head, HIDDEN)
        np.matmul(exp, np.ascontiguousarray(net["classes"].T), out=inner[:n])
        inner[:n] *= part[:, None]
        np.multiply(rows[:head], word_part[:, None], out=shares[:head])
        word_grad, words_back = np.zeros_like(words), net["words"].transpose(0, 2, 1)
        for c, run in runs:
            np.matmul(shares[run].T, within[run], out=word_grad[c])
            np.matmul(within[run], words_back[c], out=word_back[run])
        word_back *= word_part[:, None]
        inner[:head] += word_back
        inner[n] = 0
        grads = {"classes": class_grad[:HIDDEN], "class_bias": class_grad[HIDDEN], "words": word_grad[:, :HIDDEN], "word_bias": word_grad[:, HIDDEN]}
        place = np.full(len(states), n)
        place[order] = np.arange(n)
        back = np.take(inner, place, axis=0, out=room("back", kind, len(states), HIDDEN), mode="clip")
    unsorted = np.zeros(len(states), logp.dtype)
    unsorted[order] = logp
    return unsorted, grads, back


def _sums_by_word(words: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Adds to each word's row of ``out`` its rows of ``values``; runs of 1, 2, 4, ... rows are summed as one block."""
    order, n = np.argsort(words, kind="stable"), np.bincount(words, minlength=len(out))
    first = np.cumsum(n) - n
    for bit in range(int(n.max()).bit_length()):
        size = 1 << bit
        has = np.flatnonzero(n & size)
        rows = order[(first[has] + (n[has] & (size - 1)))[:, None] + np.arange(size)]
        out[has] += values.take(rows, axis=0).sum(axis=1)


def window_gradients(net: dict, given: np.ndarray, goal: np.ndarray, start: np.ndarray, state: np.ndarray, room: _Room | None = None):
    """Gradients of the summed loss over a window's live tokens, their number and the last states."""
    (steps, lanes), kind, room = given.shape, state.dtype, room or _Room()
    states, (before, acts, parts) = run_window(net, given, start, state, True, room)
    flat = goal.reshape(-1)
    _, grads, back = output(net, _rows(states), flat, True, room)
    after, back = states.transpose(0, 2, 1), back.reshape(steps, lanes, HIDDEN)
    update, reset, new = acts
    # What each step's gradient is multiplied by, for all steps at once: for the update and the reset gate, for the fresh
    # state's carried part, and for the fresh state.
    flows, to_new, spare = room("flows", kind, 3, steps, lanes, HIDDEN), room("to_new", kind, steps, lanes, HIDDEN), room("spares", kind, steps, lanes, HIDDEN)
    to_update, to_reset, to_part = flows
    np.subtract(1, update, out=spare)
    np.subtract(after, new, out=to_update)  # (before - new) * update
    to_update *= spare
    np.multiply(new, new, out=to_new)
    np.subtract(1, to_new, out=to_new)
    to_new *= spare
    np.multiply(to_new, reset, out=to_part)
    np.subtract(1, reset, out=to_reset)
    to_reset *= parts
    to_reset *= to_part
    follow, product = room("follow", kind, lanes, HIDDEN), room("product", kind, 3, lanes, HIDDEN)
    carry, begins = np.ascontiguousarray(_by_gate(net["carry"]).transpose(0, 2, 1)), start.any(axis=1).tolist()
    follow[:] = 0
    for t in range(steps - 1, -1, -1):
        d, flow = back[t], flows[:, t]
        d += follow
        flow *= d
        np.matmul(flow, carry, out=product)
        np.multiply(d, update[t], out=follow)
        for part in product:
            follow += part
        if begins[t]:
            follow[start[t]] = 0
    flat_flows = flows.reshape(3, -1, HIDDEN)
    grads["carry"] = np.matmul(before.reshape(-1, HIDDEN).T, flat_flows).transpose(1, 0, 2).reshape(HIDDEN, 3 * HIDDEN)
    np.multiply(to_new, back, out=to_part)  # from here on the flow into the fresh state
    values, sums = room("values", kind, steps * lanes, 3 * HIDDEN), np.zeros((net["input"].shape[1], 3 * HIDDEN), kind)
    _sums_by_word(given.reshape(-1).astype(np.int16), np.concatenate(list(flat_flows), axis=1, out=values), sums)
    grads["input"] = _by_gate(sums)
    return grads, int((flat >= 0).sum()), states[-1].copy()


def lanes_of(lengths: list[int], lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal documents to lanes, the longest first, each to the shortest lane: lane and first step per document."""
    import heapq

    loads = [(0, lane) for lane in range(max(1, min(lanes, len(lengths))))]
    lane, first = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for doc in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        load, at = heapq.heappop(loads)
        lane[doc], first[doc] = at, load
        heapq.heappush(loads, (load + lengths[doc], at))
    return lane, first


def _grid(streams: list[np.ndarray], lanes: int):
    """Goals by step and lane, -1 where a lane is empty, first-token flags, and the documents by lane and step.

    No more lanes than fill up beside the longest document: a grid holds at most about twice its tokens.
    """
    sizes = [len(s) for s in streams]
    lane, first = lanes_of(sizes, min(lanes, -(-sum(sizes) // max(sizes))))
    loads = np.bincount(lane, sizes).astype(np.int64)
    lane = np.argsort(np.argsort(-loads, kind="stable"), kind="stable")[lane]  # fullest lanes first, so that idle ones are cut off
    goal, start = np.full((int(loads.max()), len(loads)), -1, np.int16), np.zeros((int(loads.max()), len(loads)), bool)
    for doc, stream in enumerate(streams):
        low, at = first[doc], lane[doc]
        goal[low : low + len(stream), at], start[low, at] = stream, True
    return goal, start, np.lexsort((first, lane))


def _windows(goal: np.ndarray, start: np.ndarray, end: int):
    """Inputs, goals and first-token flags, window by window, without the lanes that are empty."""
    for low in range(0, len(goal), WINDOW):
        busy = int((goal[low] >= 0).sum())  # lanes are sorted by their ends
        goals, begins = goal[low : low + WINDOW, :busy], start[low : low + WINDOW, :busy]
        given = np.empty(goals.shape, np.int16)
        given[0], given[1:] = goal[low - 1, :busy], goals[:-1]
        given[begins | (given < 0)] = end
        yield given, goals, begins


def train_network(
    net: dict[str, np.ndarray], slices_of_streams, end: int, epochs: int = 1, lanes: int = 256, done: int = 0, rate: float = 0.01
) -> tuple[dict[str, np.ndarray], int, int]:
    """Adam with truncated backpropagation over windows of ``WINDOW`` steps; states carry over, gradients do not.

    Goes on from ``net`` after ``done`` steps. Returns the weights, the tokens seen and the steps made.
    """
    rng = np.random.default_rng(11)
    # All weights are views of one vector, so that an update is a few passes over it.
    weights, ends = np.concatenate([v.reshape(-1) for v in net.values()]), np.cumsum([v.size for v in net.values()])
    net = {k: part.reshape(v.shape) for (k, v), part in zip(net.items(), np.split(weights, ends[:-1]))}
    # Both moments without their factors 1 - 0.9 and 1 - 0.99.
    first, second, moved, count, tokens = np.zeros_like(weights), np.zeros_like(weights), np.empty_like(weights), 0, 0
    g, room = np.empty_like(weights), _Room()
    for streams in (part for whole in slices_of_streams for part in repeat(whole, epochs)):
        tokens += sum(len(s) for s in streams)
        goal, start, _ = _grid([streams[k] for k in rng.permutation(len(streams))], lanes)
        state = np.zeros((HIDDEN, goal.shape[1]), weights.dtype)
        for given, goals, begins in _windows(goal, start, end):
            found, live, state = window_gradients(net, given, goals, begins, state[:, : goals.shape[1]], room)
            count += 1
            np.concatenate([found[k].reshape(-1) for k in net], out=g)
            g /= max(live, 1)
            np.clip(g, -1, 1, out=g)
            first *= 0.9
            first += g
            np.multiply(g, g, out=g)
            second *= 0.99
            second += g
            scale = math.sqrt(0.01 / (1 - 0.99**count))
            np.sqrt(second, out=moved)
            moved += 1e-7 / scale
            np.divide(first, moved, out=moved)
            moved *= 0.1 / scale * rate / (1 + 0.003 * (done + count)) / (1 - 0.9**count)
            weights -= moved
    return {k: v.copy() for k, v in net.items()}, tokens, count


def score_streams(net: dict, streams: list[np.ndarray], end: int, lanes: int = 256) -> np.ndarray:
    """Natural log probability of every whole document's classes and frequent words."""
    sums = np.zeros(len(streams))
    if not streams:
        return sums
    goal, start, turn = _grid(streams, lanes)
    state, room, by_turn = np.zeros((HIDDEN, goal.shape[1]), np.float32), _Room(), np.zeros(len(streams))
    at = np.cumsum(np.append(0, start.sum(axis=0)))[:-1] - 1  # the document of each lane, of those by lane and step
    for given, goals, begins in _windows(goal, start, end):
        busy = goals.shape[1]
        states, _ = run_window(net, given, begins, state[:, :busy], room=room)
        state = states[-1].copy()
        logp, _, _ = output(net, _rows(states), goals.reshape(-1), room=room)
        docs = np.cumsum(begins, axis=0) + at[:busy]
        at = docs[-1]
        by_turn += np.bincount(docs.reshape(-1), logp, minlength=len(streams))
    sums[turn] = by_turn
    return sums


# ---- corpus ----------------------------------------------------------------


def _words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a slice, a number of these for each of its words, and the words of each text, without ends."""
    texts = pc.binary_join_element_wise(pc.ascii_lower(pc.fill_null(texts, "")), " ", "")
    parts = pc.ascii_split_whitespace(texts)  # at the same six characters; a last part that is empty, and a first one after space
    flat, ends = parts.flatten(), np.cumsum(pc.list_value_length(parts).to_numpy())
    real = pc.not_equal(pc.binary_length(flat), 0)
    words = flat.filter(real).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.dictionary.cast(pa.binary()), words.indices.to_numpy(), np.diff(before[np.concatenate([[0], ends])])


def count_words(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(word, n) over all training documents, the end token included."""

    def count(batches):
        words, counts, held, docs = [], [], 0, 0

        def flush():
            found = pa.chunked_array([*words, pa.array([END], pa.binary())]).combine_chunks().dictionary_encode()
            n = np.bincount(found.indices.to_numpy(), np.concatenate([*counts, [docs]])).astype(np.int64)
            words.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([found.dictionary, pa.array(n)], ["word", "n"])

        for batch in slices(batches, "text", SLICE):
            known = [fold_of_id(doc_id, folds) != 0 for doc_id in batch.column("doc_id").to_pylist()]
            if not any(known):
                continue
            distinct, at, _ = _words_of(batch.column("text").filter(pa.array(known)))
            words.append(distinct)
            counts.append(np.bincount(at, minlength=len(distinct)))
            held, docs = held + len(distinct), docs + sum(known)
            if held > 1_000_000:
                yield flush()
                held = docs = 0
        if docs:
            yield flush()

    return docs.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


CODED_SCHEMA = (
    "uid long, word binary, posts binary, part int, first int, ids array<long>, n_tokens array<long>, known array<long>, logs array<double>, tails array<double>, stream binary"
)
_CODED = pa.schema([("uid", pa.int64()), ("word", pa.binary()), ("posts", pa.binary()), ("part", pa.int32()), ("first", pa.int32()), ("ids", pa.list_(pa.int64())),
                    ("n_tokens", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("logs", pa.list_(pa.float64())), ("tails", pa.list_(pa.float64())),
                    ("stream", pa.binary())])


def _posts(distinct: pa.Array, at: np.ndarray, doc: np.ndarray, uid: int) -> pa.RecordBatch:
    """One row per distinct word of ``at``: its (document, times) pairs."""
    key, times = np.unique(at.astype(np.int64) << 32 | doc, return_counts=True)
    pairs = np.stack([(key & 0xFFFFFFFF).astype("<u4"), times.astype("<u4")], axis=1)
    word, n = np.unique(key >> 32, return_counts=True)
    ends = np.concatenate([[0], np.cumsum(n * 8)]).astype(np.int32)
    posts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(n), uid)), distinct.take(pa.array(word)), posts, *(pa.nulls(len(n), f.type) for f in list(_CODED)[3:])], schema=_CODED)


def _code_slices(shared):
    """The only pass that reads texts for the network. Per slice and part a row of its documents' sums and stream ids,
    and one row per word whose count is not at hand."""

    def code(batches):
        model = shared.value
        order = model["order"]
        words, end = pa.array([w for w, _ in order], pa.binary()), model["end"]
        # The entry after the last, which -1 takes, is that of a word whose count is not at hand.
        known_log = np.append(np.log10(np.array([n for _, n in order]) + 0.1), 0.0)
        has = np.append(np.array([n > 0 for _, n in order]), False)
        stream_id = np.array([at if at < MODEL_WORDS else MODEL_WORDS + tail_class(w) for at, (w, _) in enumerate(order)] + [0], np.int16)
        class_log = np.log10(model["tail_n"] + 0.1 * (model["tail_v"] + 1))
        # Tail words' own logs, without those still to come, less their classes' totals.
        tail_log = np.where(stream_id >= MODEL_WORDS, known_log - class_log[np.maximum(stream_id - MODEL_WORDS, 0)], 0.0)
        task, number = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", SLICE):
            uid, number = (task << 24) | number, number + 1
            part = batch.column("part").to_numpy()
            turn = np.argsort(part, kind="stable")  # a part's documents are one run
            batch, part = batch.take(pa.array(turn)), part[turn]
            distinct, at, n_words = _words_of(batch.column("text"))
            places = pc.fill_null(pc.index_in(distinct, words), -1).to_numpy()
            ids, tails, rare = stream_id[places], tail_log[places], np.flatnonzero(places < 0)
            ids[rare] = [MODEL_WORDS + tail_class(w) for w in distinct.take(pa.array(rare)).to_pylist()]
            tails[rare] = -class_log[ids[rare] - MODEL_WORDS]
            # Ends come after every text's words: as one more distinct word.
            ends = np.cumsum(n_words)
            at = np.insert(at, ends, len(distinct))
            start = ends - n_words + np.arange(len(ends))
            sums = lambda by_word, by_end: np.add.reduceat(np.append(by_word, by_end)[at], start)
            known, logs = sums(has[places].astype(np.int64), int(has[end])), sums(known_log[places], known_log[end])
            tails = sums(tails, 0.0)
            stream = np.append(ids, end).astype("<i2")[at]
            bounds = np.append(start, len(at))
            for low, high in _runs(part):
                doc = slice(low, high)
                row = (uid, None, None, part[low], low, batch.column("doc_id")[doc].to_pylist(), n_words[doc] + 1, known[doc], logs[doc], tails[doc],
                       stream[bounds[low] : bounds[high]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _CODED)], schema=_CODED)
            if len(rare):
                is_rare = np.append(places < 0, False)[at]
                yield _posts(distinct, at[is_rare], np.repeat(np.arange(len(ends)), n_words + 1)[is_rare], uid)

    return code


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    return list(zip(cuts.tolist(), cuts[1:].tolist()))


def code_documents(docs: DataFrame, model: dict, folds: int, rounds) -> DataFrame:
    """All documents as stream ids, written once. A training document's part is its round, any other's -1."""
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES))
    turn = sum((share >= low).cast("int") for low, _ in rounds[1:]) if rounds[1:] else F.lit(0)
    # NULL ids count as training documents, as in the word counts.
    held = F.coalesce(fold_of(F.col("doc_id"), folds) == 0, F.lit(False))
    rows = docs.select("doc_id", "text", F.when(held, -1).otherwise(turn).cast("int").alias("part"))
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("order", "end", "tail_n", "tail_v")})
    coded = stored(rows.mapInArrow(_code_slices(shared), CODED_SCHEMA), "lm-slices")
    shared.unpersist()
    return coded


def _gathered(batches):
    """Rows with their documents' streams, as many together as hold ``SLICE_TOKENS`` tokens, or one."""
    held, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            stream = np.frombuffer(row.column("stream")[0].as_buffer(), "<i2")
            if held and size + len(stream) > SLICE_TOKENS:
                yield held
                held, size = [], 0
            ends = np.cumsum(row.column("n_tokens")[0].values.to_numpy())
            held.append((row, np.split(stream, ends[:-1])))
            size += len(stream)
    if held:
        yield held


_NET_SCHEMA = "net binary, tokens long, steps long"


def _net_row(net: dict[str, np.ndarray], tokens: int, steps: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"net": pa.array([pickle.dumps(net)], pa.binary()), "tokens": pa.array([tokens], pa.int64()), "steps": pa.array([steps], pa.int64())}
    )


def _train_slices(shared, epochs: int, lanes: int):
    """Trains on all rows of a task, slice by slice: one row of its weights, its tokens and its steps."""

    def train(batches):
        model = shared.value
        found = ([stream for _, streams in rows for stream in streams] for rows in _gathered(batches))
        net, tokens, steps = train_network(model["net"], found, model["end"], epochs, lanes, model["steps"])
        if tokens:
            yield _net_row(net, tokens, steps)

    return train


def _mean_nets(batches):
    """The mean of the weights, weighted by tokens; steps likewise."""
    sums, tokens, steps = {}, 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            for k, v in pickle.loads(row["net"]).items():
                sums[k] = sums.get(k, 0) + v.astype(np.float64) * row["tokens"]
            tokens, steps = tokens + row["tokens"], steps + row["steps"] * row["tokens"]
    if tokens:
        yield _net_row({k: (v / tokens).astype(np.float32) for k, v in sums.items()}, tokens, steps // tokens)


def round_tasks(n: int, low: int, high: int, task_tokens: int) -> int:
    """Tasks of the round that takes the shares from ``low`` to ``high`` of ``n`` tokens."""
    return max(1, n * (high - low) // (SHARES * ROUND_TASK * task_tokens))


def train_over(coded: DataFrame, model: dict, task_tokens: int, rounds, epochs: int, lanes: int) -> tuple[dict, int]:
    """The network after every training document of ``coded``, and the tokens that it has learned from."""
    spark = coded.sparkSession
    net, steps, learned = model["net"], 0, 0
    for turn, (low, high) in enumerate(rounds):
        tasks = round_tasks(model["n"], low, high, task_tokens)
        shared = spark.sparkContext.broadcast({"end": model["end"], "net": net, "steps": steps})
        rows = coded.filter(F.col("part") == turn).select("n_tokens", "stream")
        nets = rows.coalesce(tasks).mapInArrow(_train_slices(shared, epochs, lanes), _NET_SCHEMA)
        width = min(tasks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2))
        while width > 1:
            width = -(-width // FAN_IN)
            nets = nets.repartition(width).mapInArrow(_mean_nets, _NET_SCHEMA)
        for row in nets.collect():
            net, steps, learned = pickle.loads(row.net), steps + row.steps, learned + row.tokens // epochs
        shared.unpersist()
    return net, learned


def fit_model(docs: DataFrame, words: DataFrame, folds: int = FOLDS, frequent: int = FREQUENT, task_tokens: int = TASK_TOKENS) -> dict:
    """Counts of the most frequent words, class totals and the trained network, all bounded by the parameters, and the coded documents."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Sixteen steps per doubling: as many of the highest whole steps as hold at most ``frequent`` words.
    grade = F.floor(F.log2("n") * 16)
    steps, room, least = words.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("v")).collect(), frequent, 1 << 20
    for row in sorted(steps, key=lambda r: -r.g):
        if row.v > room:
            break
        room, least = room - row.v, row.g
    top = [(bytes(r.word), r.n) for r in words.filter(grade >= least).collect()]
    top.sort(key=lambda t: (-t[1], t[0]))
    ends = words.filter(F.col("word") == F.lit(END)).first()  # the end token is a model word however many words are more frequent
    head = [t for t in top[:MODEL_WORDS] if t[0] != END][: MODEL_WORDS - 1] + [(END, ends.n if ends else 0)]
    head.sort(key=lambda t: -t[1])
    chosen = {w for w, _ in head}
    head += [(b" %d" % k, 0) for k in range(MODEL_WORDS - len(head))]  # stand-ins for a small vocabulary; no word has a space
    order = head + [t for t in top if t[0] not in chosen]
    by_tail = words.groupBy((F.crc32(F.expr(f"substring(word, greatest(length(word) - {TAIL_BYTES - 1}, 1), {TAIL_BYTES})")) % TAIL_CLASSES).cast("int").alias("c"))
    tail_n, tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for row in by_tail.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tail_n[row.c], tail_v[row.c] = row.n, row.v
    for word, n in head:
        if n:
            tail_n[tail_class(word)] -= n
            tail_v[tail_class(word)] -= 1
    counts = np.array([n for _, n in head], np.float64)
    end = next(at for at, (w, _) in enumerate(head) if w == END)
    model = {"order": order, "net": new_network(np.random.default_rng(11), counts), "end": end, "tail_n": tail_n, "tail_v": tail_v, "n": total.n, "v": total.v}
    tasks = max(1, model["n"] // task_tokens)
    rounds, epochs, lanes = (ROUNDS, 1, 256) if tasks > 1 else (((0, SHARES),), SMALL_EPOCHS, 64)
    model["coded"] = code_documents(docs, model, folds, rounds)
    model["net"], model["learned"] = train_over(model["coded"], model, task_tokens, rounds, epochs, lanes)
    return model


PART_SCHEMA = "uid long, first int, ids array<long>, n_tokens array<long>, known array<long>, logs array<double>, tails array<double>, net array<double>"


def _score_slices(shared):
    """The rows of documents, with the network's scores in place of the streams."""

    def score(batches):
        model = shared.value
        for rows in _gathered(batches):
            net = score_streams(model["net"], [stream for _, streams in rows for stream in streams], model["end"]) / np.log(10)
            ends = np.cumsum([len(streams) for _, streams in rows])
            for (row, _), part in zip(rows, np.split(net, ends[:-1])):
                kept = row.drop_columns(["stream"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([part], pa.list_(pa.float64()))], [*kept.schema.names, "net"])

    return score


def _rare_sums(batches):
    """Adds up each document's logs of joined counts, per slice, before anything is shuffled."""
    held, size = [], 0

    def flush():
        uid, doc, times, n = (np.concatenate(c) for c in zip(*held))
        held.clear()
        uids, at = np.unique(uid, return_inverse=True)
        key, at = np.unique(at << 32 | doc, return_inverse=True)
        logs = np.bincount(at, times * np.log10(n + 0.1)).astype("<f8")
        hits = np.bincount(at, times * (n > 0)).astype("<f8")
        docs = (key & 0xFFFFFFFF).astype("<u4")
        rows = [(uids[key[low] >> 32], docs[low:high].tobytes(), logs[low:high].tobytes(), hits[low:high].tobytes()) for low, high in _runs(key >> 32)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["uid", "docs", "rare_logs", "hits"])

    for batch in batches:
        posts = batch.column("posts")
        if not len(posts):
            continue
        ends = np.frombuffer(posts.buffers()[1], np.int32)[posts.offset : posts.offset + len(posts) + 1]
        pairs = np.frombuffer(posts.buffers()[2], "<u4")[ends[0] // 4 : ends[-1] // 4].reshape(-1, 2)
        times = np.diff(ends) // 8
        uid, n = (np.repeat(batch.column(c).to_numpy(), times) for c in ("uid", "n"))
        held.append((uid, pairs[:, 0].astype(np.int64), pairs[:, 1].copy(), n))
        size += len(pairs)
        if size > 2_000_000:
            yield flush()
            size = 0
    if held:
        yield flush()


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(n: int, v: int, folds: int):
    names = [part.split()[0] for part in SCORE_SCHEMA.split(", ")]

    def finish(batches):
        current, main, rest = None, [], []

        def settle():
            if not main:
                return None
            main.sort(key=lambda row: row["first"])
            known, logs, tails, tokens, net = (np.concatenate([row[k] for row in main]) for k in ("known", "logs", "tails", "n_tokens", "net"))
            ids = [i for row in main for i in row["ids"]]
            for docs, rare_logs, hits in rest:
                at = np.frombuffer(docs, "<u4")
                logs[at] += np.frombuffer(rare_logs, "<f8")
                tails[at] += np.frombuffer(rare_logs, "<f8")
                known[at] += np.frombuffer(hits, "<f8").astype(np.int64)
            base = logs - tokens * np.log10(n + 0.1 * (v + 1))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([fold_of_id(i, folds) == 0 for i in ids]), pa.array(tokens), pa.array(known),
                 pa.array(np.full(len(tokens), n)), pa.array(base), pa.array(net + tails)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["uid"] != current:
                    out = settle()
                    if out:
                        yield out
                    current, main, rest = row["uid"], [], []
                if row["ids"] is not None:
                    main.append(row)
                else:
                    rest.append((row["docs"], row["rare_logs"], row["hits"]))
        out = settle()
        if out:
            yield out

    return finish


def score_documents(docs: DataFrame, folds: int = FOLDS, frequent: int = FREQUENT) -> DataFrame:
    """Count, fit and score; one row per document."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = stored(count_words(rows, folds), "lm-words")
    model = fit_model(rows, words, folds, frequent)
    coded = model["coded"]
    rare = coded.filter("word IS NOT NULL").select("uid", "word", "posts").join(words, "word", "left").select("uid", "posts", F.coalesce("n", F.lit(0)).alias("n"))
    sums = rare.mapInArrow(_rare_sums, "uid long, docs binary, rare_logs binary, hits binary")
    shared = spark.sparkContext.broadcast({"net": model["net"], "end": model["end"]})
    mains = coded.filter("word IS NULL").drop("word", "posts", "part").mapInArrow(_score_slices(shared), PART_SCHEMA)
    both = mains.unionByName(sums, allowMissingColumns=True)
    return both.repartition(parts, "uid").sortWithinPartitions("uid").mapInArrow(_finish(model["n"], model["v"], folds), SCORE_SCHEMA)
