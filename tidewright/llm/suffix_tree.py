"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the training words, a document's end, and one for all unknown words. A context of d words is a
state if its suffix of d - 1 words is one (the root always is), if it occurs twice or more, and if its
next-symbol distribution diverges enough from its suffix's: the nats that it saves over all its
occurrences must pay for naming each different next symbol, which costs the logarithm of the number of
words (Ron, Singer and Tishby, "The power of amnesia"). A state's distribution is smoothed towards its suffix's, and the longest suffix state scores
each token. Every word that stands before another is a context, and contexts grow as deep as there are
states: no word, count or depth is left out.

Tokens stay where their documents are, in slabs of about TOKENS tokens. A round sums up what all slabs
say about keys (words, contexts with what follows them, contexts): each slab hands on its distinct keys
with its own sums, keys are dealt to buckets by hash, and each slab gets back the whole sums of the
keys that it has named. A hot word is one key of each slab, and a bucket holds about ASKS keys. Depth by
depth one round counts, and one adds up savings in whole units, so that sums don't depend on their order.
On disk a round keeps little besides the slabs and the sums for them: the first rounds take on the slabs part by part,
each in the place of what it was before, and ask for pairs of words range of keys by range.
Words and contexts are hashes of up to 64 bits, as many as the number
of tokens asks for.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import U64, Scratch, lower_ascii, mix64, prefix_hash, range_hash, spans, text_slabs, white

#: Tokens of a slab (a longer document is a slab of its own) and keys of a bucket, about; the fewest buckets.
TOKENS, ASKS, BUCKETS = 1 << 19, 1 << 19, 64
#: Parts of the slabs and ranges of the keys of pairs that a round takes one by one; with fewer tokens than MANY it takes all at once.
PARTS, RANGES, MANY = 6, 2, 1 << 24
#: Weight of the suffix in smoothing; units of a nat; bits that a key has beyond those that number the tokens.
WEIGHT, UNITS, SPARE = 1.0, 1 << 20, 20

_SLAB = "slab long, state binary, active long"
_END = np.zeros(1, U64)
_MULTIPLIER, _FOLLOWS = U64(0xD1342543DE82EF95), U64(0x6C62272E07BB0142)


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as compressed bytes, byte plane by byte plane: high bytes of small numbers come to nothing."""
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays.values()]
    body = b"".join([len(head).to_bytes(4, "little"), head, *planes])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, n in json.loads(raw[4:at]):
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind)
        at += n * size
    return out


def _tokens(column):
    """Words of each text and its end, slab by slab: first row, hashes, and tokens of each row."""
    for first, b, off in text_slabs(column):
        b = lower_ascii(b)
        s, e, row = spans(~white(b), off)
        size = np.bincount(row, minlength=len(off) - 1)
        yield first, np.insert(range_hash(prefix_hash(b), s, e), np.cumsum(size), _END[0]), size + 1


def slabs(docs: DataFrame) -> DataFrame:
    """(slab, state, active, part): documents (doc_id, text, train) as slabs of tokens."""

    parts = PARTS

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def row():
            nonlocal made
            made += 1
            ids, null, train, size, word = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            words, stream, count = np.unique(word, return_inverse=True, return_counts=True)
            # By count: places of frequent words are small numbers.
            order = np.argsort(-count)
            back = np.empty(len(order), np.uint32)
            back[order] = np.arange(len(order), dtype=np.uint32)
            words, stream = words[order], back[stream]
            state = pack({"ids": ids, "null": null, "train": train, "size": size.astype(np.int64), "words": words, "stream": stream})
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([state], pa.binary()), pa.array([len(word)], pa.int64()), pa.array([(task + made) % parts], pa.int32())], names=["slab", "state", "active", "part"])

        n = 0
        for batch in batches:
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            ids, train = ids.fill_null(0).to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            for first, word, size in _tokens(batch.column("text")):
                part = slice(first, first + len(size))
                held.append((ids[part], null[part], train[part], size, word))
                n += len(word)
                if n >= TOKENS:
                    yield row()
                    n = 0
        if held:
            yield row()

    return docs.mapInArrow(run, f"{_SLAB}, part int")


def _lookup(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


def _sums(where: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Whole numbers below 2**53, so that they add up exactly."""
    return np.bincount(where, values, n).astype(np.int64)


def _told(where: np.ndarray, n: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` keys, its tokens in training and whether it has others."""
    return _sums(where, n, train), np.bincount(where[~train], minlength=n) > 0


class Slab:
    """Documents of a slab, and what is known of their tokens so far.

    Steps: words, pairs of words, savings of words, and then counts and savings for each further depth.
    ``ask`` gives a step's keys, in ascending order, the slab's own sums, and where a token that is held out
    wants them; ``take`` takes the whole sums of those keys and whether any slab's tokens want them, and
    goes on to the next step. Pairs can be asked for range by range of all keys. ``model`` has the bits of a key, and from the second step
    on the number of training tokens, the share of unknown words and the nats that naming a symbol costs.
    """

    def __init__(self, raw: bytes, model: tuple):
        self.has, self.model = unpack(raw), model
        self.shift = U64(64 - model[0])
        self.step = int(self.has.pop("step", np.zeros(1, np.int64))[0])
        if self.step < 3:
            self.train = np.repeat(self.has["train"], self.has["size"])

    @property
    def doc(self) -> np.ndarray:
        """The document of each token."""
        return np.repeat(np.arange(len(self.has["size"])), self.has["size"])

    def raw(self) -> bytes:
        return pack({**self.has, "step": np.array([self.step], np.int64)})

    @property
    def active(self) -> int:
        return len(self.has["stream" if self.step < 3 else "at"])

    def _word(self, at: np.ndarray) -> np.ndarray:
        return self.has["words"][self.has["stream"][at]]

    def _context(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Hashes of the ``depth`` words before each of the tokens ``at``, which must be there."""
        h = np.full(len(at), depth, U64)
        for k in range(1, depth + 1):
            h = mix64(h * _MULTIPLIER + self._word(at - k))
        return h

    def _follows(self, context: np.ndarray, at: np.ndarray) -> np.ndarray:
        return mix64((context ^ _FOLLOWS) * _MULTIPLIER + self._word(at)) >> self.shift

    def _add(self, doc: np.ndarray, values: np.ndarray) -> None:
        self.has["score"] = self.has["score"] + np.bincount(doc, values, len(self.has["size"]))

    def ask(self, range_: int = 0, ranges: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.active:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, bool)
        if self.step == 0:
            keys, where = _lookup(self.has["words"] >> self.shift)
            return keys, *_told(where[self.has["stream"]], len(keys), self.train)
        if self.step == 1:
            at = self._firsts()[2]
            pairs = self._pairs(at)
            if ranges > 1:
                mine = _shares(pairs, self.model, ranges) == range_
                at, pairs = at[mine], pairs[mine]
            keys, where = _lookup(pairs)
            return keys, *_told(where, len(keys), self.train[at])
        if self.step == 2:
            at = self._firsts()[0]
            keys, where = self._first_contexts()
            return keys, self._saved(len(keys), where[self.has["stream"][at - 1]], *self._first_shares(at), self.train[at]), np.zeros(len(keys), bool)
        if self.step % 2 == 0:  # savings
            keys, where = _lookup(self._context(self.has["at"].astype(np.int64), self.step // 2) >> self.shift)
            saved = self._saved(len(keys), where, self.has["total"], self.has["n"], self.has["lp"].astype(float), self.has["train"][self.has["of"]])
            return keys, saved, np.zeros(len(keys), bool)
        return self._counts(self.has["at"].astype(np.int64), self.has["train"][self.has["of"]], (self.step + 1) // 2)[:3]

    def take(self, sums: np.ndarray, wanted: np.ndarray) -> None:
        if self.step > 2 and not self.active:
            return
        (self._take_words if self.step == 0 else self._take_pairs if self.step == 1 else self._take_first_savings if self.step == 2
         else self._take_counts if self.step % 2 else self._take_savings)(sums, wanted)
        self.step += 1

    # Depth 0: words.

    def _take_words(self, sums, wanted):
        words, stream = self.has["words"] >> self.shift, self.has["stream"]
        where = _lookup(words)[1]
        c, want = sums[where], wanted[where]
        size = self.has["size"]
        first = np.cumsum(size) - size  # every document has a token
        self.has |= {"known": np.add.reduceat((c > 0)[stream], first, dtype=np.int64), "base": np.add.reduceat(np.log(c + 1.0)[stream], first), "score": np.zeros(len(size))}
        # A word that only one token of all has is no context, and nobody asks what it follows: all those are one here.
        named = (c >= 2) | want
        number = np.where(named, np.cumsum(named) - 1, named.sum()).astype(np.uint32)
        self.has |= {"words": np.append(words[named], U64(0)), "c": np.append(c[named], 1), "want": np.append(want[named], False), "stream": number[stream]}

    def _roots(self) -> np.ndarray:
        """Log probability of each distinct word at the root."""
        _, n, unknown, _ = self.model
        c = self.has["c"]
        return np.where(c > 0, np.log(np.maximum(c, 1) / n * (1 - unknown)), np.log(unknown))

    # Depth 1: a word and what follows it.

    def _firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens after a word that occurs twice, whether their count must be asked for, and those where it must."""
        c, stream, size = self.has["c"], self.has["stream"], self.has["size"]
        after = np.append(False, (c >= 2)[stream[:-1]])
        after[np.cumsum(size) - size] = False
        at = np.flatnonzero(after)
        asked = ((c > 1) | ((c == 1) & self.has["want"]))[stream[at]]
        return at, asked, at[asked]

    def _pairs(self, at: np.ndarray) -> np.ndarray:
        """Keys of tokens with the word before them."""
        words, stream = self.has["words"], self.has["stream"]
        before = (mix64(words + _MULTIPLIER) ^ _FOLLOWS) * _MULTIPLIER
        return mix64(before[stream[at - 1]] + words[stream[at]]) >> self.shift

    def _take_pairs(self, sums, wanted):
        at, asked, some = self._firsts()
        n = np.minimum(self.has["c"][self.has["stream"][at]], 1)
        where = _lookup(self._pairs(some))[1]
        want = np.zeros(len(n), bool)
        n[asked], want[asked] = sums[where], wanted[where]
        self.has |= {"n": n, "want2": want}

    def _first_contexts(self):
        """Keys of the words that occur twice, and the place among them of each word."""
        some = np.flatnonzero((self.has["c"] >= 2) & (self.has["words"] != 0))  # 0: an end
        where = np.zeros(len(self.has["words"]), np.int64)
        keys, where[some] = _lookup(mix64(self.has["words"][some] + _MULTIPLIER) >> self.shift)
        return keys, where

    def _first_shares(self, at):
        stream, c = self.has["stream"], self.has["c"]
        return c[stream[at - 1]], self.has["n"], self._roots()[stream[at]]

    def _saved(self, n_keys, where, total, n, lp, train):
        """What the training tokens of each context save over its suffix, less the costs of symbols, in whole units."""
        n = n[train]
        each = np.rint((np.log(n / total[train]) - lp[train] - self.model[3] / n) * UNITS)
        return _sums(where[train], n_keys, each)

    def _take_first_savings(self, sums, wanted):
        at = self._firsts()[0]
        where = self._first_contexts()[1][self.has["stream"][at - 1]]
        stream, roots = self.has["stream"], self._roots()
        total, n, lp = self._first_shares(at)
        rest = np.ones(len(stream), bool)
        rest[at] = False
        doc = self.doc
        self._add(doc[rest], roots[stream[rest]])
        twice = np.zeros(len(stream), bool)
        twice[at] = n >= 2
        want = self.has.pop("want2")
        for name in ("c", "n", "want"):
            del self.has[name]
        self._deepen(at, doc[at], total, n, want, lp, sums[where] >= 0, twice, 1)

    # From depth to depth.

    def _deepen(self, at, doc, total, n, want, lp, state, twice, depth):
        """Score by the states of ``depth``; what may have a state below goes on, with the words that it may need.

        ``twice`` tells the tokens that occur twice with the word before them: a context grows by a word
        only there, else it occurs once at most.
        """
        lp = np.where(state, np.log((n + WEIGHT * np.exp(lp)) / (total + WEIGHT)), lp)
        on = state & twice[at - depth]
        self._add(doc[~on], lp[~on])
        at, stream = at[on], self.has["stream"]
        # Words before a token, back to where one doesn't occur twice with the word before it.
        run = np.cumsum(~twice)
        needed = np.zeros(int(run[-1]) + 1 if len(run) else 0, bool)
        needed[run[at - 1]] = True
        keep = needed[run] if len(run) else np.zeros(0, bool)
        keep[at] = True
        used, stream = np.unique(stream[keep], return_inverse=True)
        self.has |= {
            "words": self.has["words"][used], "stream": stream.astype(np.uint32), "twice": np.packbits(twice[keep]),
            "at": (np.cumsum(keep) - 1)[at].astype(np.uint32), "of": doc[on].astype(np.uint32), "lp": lp[on].astype(np.float32), "some": np.minimum(n[on], 2).astype(np.uint8), "want": want[on]}

    def _counts(self, at, train, depth):
        """Keys, sums and wants of the contexts and of what follows them, and the places among the keys of each token's.

        What never has followed a context never follows a longer one; what has once does so once more in its
        own place, which is asked for only if a token that is held out wants it.
        """
        context, some = self._context(at, depth), self.has["some"]
        asked = (some > 1) | ((some == 1) & self.has["want"])
        one, of = _lookup(context >> self.shift)
        two, to = _lookup(self._follows(context[asked], at[asked]))
        keys, back = _lookup(np.append(one, two))
        told = [np.append(x, y) for x, y in zip(_told(of, len(one), train), _told(to, len(two), train[asked]), strict=True)]
        return keys, _sums(back, len(keys), told[0]), _sums(back, len(keys), told[1]) > 0, back[:len(one)][of], asked, back[len(one):][to]

    def _take_counts(self, sums, wanted):
        at, doc = self.has["at"].astype(np.int64), self.has["of"]
        _, _, _, of, asked, to = self._counts(at, self.has["train"][doc], (self.step + 1) // 2)
        total, n = sums[of], self.has.pop("some").astype(np.int64)
        want = np.zeros(len(n), bool)
        n[asked], want[asked] = sums[to], wanted[to]
        m = total >= 2
        self._add(doc[~m], self.has["lp"][~m].astype(float))
        self.has |= {"total": total[m], "n": n[m], "want": want[m], **{k: self.has[k][m] for k in ("at", "of", "lp")}}

    def _take_savings(self, sums, wanted):
        at, depth = self.has["at"].astype(np.int64), self.step // 2
        where = _lookup(self._context(at, depth) >> self.shift)[1]
        twice = np.unpackbits(self.has["twice"], count=len(self.has["stream"])).view(bool)
        self._deepen(at, self.has["of"], self.has.pop("total"), self.has.pop("n"), self.has["want"], self.has["lp"].astype(float), sums[where] >= 0, twice, depth)


def _shares(keys: np.ndarray, model: tuple, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges each key is in."""
    return ((keys >> U64(model[0] - 32)) * U64(n)) >> U64(32)


def _asked(model: tuple, buckets: int, range_: int = 0, ranges: int = 1):
    """(slab, bucket, asks): what each slab asks each bucket; buckets are ranges of keys, as many in each of ``ranges``."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                slab = Slab(batch.column("state")[k].as_py(), model)
                keys, values, wants = slab.ask(range_, ranges)
                signs = np.array([slab.step > 0 and slab.step % 2 == 0])
                bucket = _shares(keys, model, buckets)
                at = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U64))
                some = np.flatnonzero(at[1:] > at[:-1])
                # Differences of ascending keys: a part of a key's bytes.
                asks = [pack({"k": np.diff(keys[at[b]:at[b + 1]], prepend=U64(0)), "v": values[at[b]:at[b + 1]], "w": wants[at[b]:at[b + 1]], "s": signs}) for b in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), batch.column("slab")[k].as_py(), np.int64)), pa.array(some.astype(np.int32)), pa.array(asks, pa.binary())], names=["slab", "bucket", "asks"])

    return run


def _sum_up(table: pa.Table) -> pa.Table:
    """A bucket's sums for each slab that asks; their total, and how many are positive and how many 1, in its first row.

    Of savings, the asks say, no more than the sign is wanted.
    """
    asks = [unpack(x.as_py()) for x in table.column("asks")]
    every, where = _lookup(np.concatenate([np.cumsum(x["k"], dtype=U64) for x in asks]))
    order = np.argsort(where, kind="stable")
    sums = np.add.reduceat(np.concatenate([x["v"] for x in asks])[order], np.searchsorted(where[order], np.arange(len(every))))
    total, distinct, once = sums.sum(), (sums > 0).sum(), (sums == 1).sum()
    if asks[0]["s"][0]:
        sums = np.where(sums < 0, -1, 0)
    wanted = np.bincount(where[np.concatenate([x["w"] for x in asks])], minlength=len(every)) > 0
    parts = np.split(where, np.cumsum([len(x["k"]) for x in asks])[:-1])
    first = lambda x: pa.array([int(x)] + [0] * (len(parts) - 1), pa.int64())
    columns = [table.column("slab"), table.column("bucket"), pa.array([pack({"v": sums[p], "w": wanted[p]}) for p in parts], pa.binary()), first(total), first(distinct), first(once)]
    return pa.Table.from_arrays(columns, names=["slab", "bucket", "sums", "total", "distinct", "once"])


def _advanced(model: tuple):
    def run(states: pa.Table, answers: pa.Table) -> pa.Table:
        slab = Slab(states.column("state")[0].as_py(), model)
        order = np.argsort(answers.column("bucket").to_numpy())
        parts = [unpack(answers.column("sums")[k].as_py()) for k in order.tolist()] or [{"v": np.zeros(0, np.int64), "w": np.zeros(0, bool)}]
        slab.take(*(np.concatenate([x[name] for x in parts]) for name in "vw"))
        return pa.table({"slab": states.column("slab"), "state": pa.array([slab.raw()], pa.binary()), "active": pa.array([slab.active], pa.int64())})

    return run


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores of each row of ``docs`` (doc_id, text), learned from those with crc32(doc_id as text) mod 7 not 2.

    doc_id, held_out, n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (add-one unigrams over the known words and one more) and score (the model's), both log10.
    Unknown words are one symbol in both; the model gives it the share that words seen once have.
    Null and empty texts are an end alone; a null doc_id is not held out; equal rows count as often as
    they stand; without training rows nothing is known. A text is tokenized in one task, whole. Further
    columns are ignored.
    """
    scratch = Scratch(spark, "suffix-tree")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (~_held_out()).alias("train"))
    first = scratch.keep(slabs(docs), "slabs", by="part")
    sizes = {x["part"]: x["n"] for x in first.groupBy("part").agg(F.sum("active").alias("n")).collect()}
    now = {part: scratch.one(first, "part", part) for part in sorted(sizes)} or {None: first}
    active = sum(sizes.values())
    # Keys have so many bits that one in 2**SPARE is taken for another at most.
    model: tuple = (min(64, max(40, active.bit_length() + SPARE)),)
    total = distinct = step = 0
    while active:
        ranges = RANGES if step == 1 and active >= MANY else 1
        buckets = -(-max(BUCKETS, -(-active // ASKS)) // ranges) * ranges
        every = reduce(DataFrame.union, now.values())
        told = []
        for k in range(ranges):
            asks = every.where("active > 0").select("slab", "state").mapInArrow(_asked(model, buckets, k, ranges), "slab long, bucket int, asks binary")
            answers = asks.groupBy("bucket").applyInArrow(_sum_up, "slab long, bucket int, sums binary, total long, distinct long, once long")
            told.append(scratch.keep(answers, "answers"))
        answers = reduce(DataFrame.union, told)
        if len(model) == 1:
            total, distinct, once = (int(x or 0) for x in answers.agg(F.sum("total"), F.sum("distinct"), F.sum("once")).first())
            model = (model[0], max(total, 1), min(max(once, 1) / (max(total, 1) + 1), 0.5), float(np.log(max(distinct, 2))))
        sums = answers.select("slab", "bucket", "sums")
        # A part of the slabs goes once the same part of the next ones is there.
        after = {}
        for part, old in (now if active >= MANY else {None: every}).items():
            of = sums if part is None else sums.where((F.shiftright("slab", 32) + F.col("slab").bitwiseAND((1 << 32) - 1)) % PARTS == part)
            new = old.select("slab", "state").groupBy("slab").cogroup(of.groupBy("slab")).applyInArrow(_advanced(model), _SLAB)
            after[part] = scratch.keep(new, "slabs")
            for table in now.values() if part is None else [old]:
                scratch.drop(table)
        for table in told:
            scratch.drop(table)
        now = after
        active = reduce(DataFrame.union, now.values()).agg(F.sum("active")).first()[0] or 0
        step += 1

    def rows(batches):
        for batch in batches:
            for raw in batch.column("state"):
                s = unpack(raw.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s["ids"], mask=s["null"]), pa.array(~s["train"]), pa.array(s["size"]), pa.array(s["known"]), pa.array(s["base"]), pa.array(s["score"])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    out = reduce(DataFrame.union, now.values()).select("state").mapInArrow(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    log10 = float(np.log(10))
    base = F.col("base") / log10 - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") / log10).alias("score"))
