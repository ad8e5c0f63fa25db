"""Exact token counts of every prefix of a text, by dynamic programming over a piece vocabulary.

Pieces of a BPE model follow one another in the encoding of a text exactly if every two neighbours are
the encoding of the two put together. So a prefix has one last piece: the one that ends there and
goes with the last piece of the prefix before it. Its count is one more than that prefix's. Going over the
places of a text once gives the count of every prefix; the text is never encoded, and no question about a
truncation or a budget needs it again.

The work is done for many words at once. Texts are cut where no piece holds the two characters on both
sides of a place; level by level, all cuts' beginnings advance through a double-array trie of the pieces by
one character, and what ends in a piece is tested against the last piece before it. Runs of blanks,
whose pieces all have one priority and join from the left, are counted by a stack. Characters that no
piece has are as many tokens as they have bytes. A worker counts a distinct word once and keeps the
answer for as long as its table stays small; nothing is shuffled, so no key can be hot.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcurate.llm.common import arrow_type, map_texts
from sparkcurate.llm.trie import DoubleArray

#: The character that stands for a blank in pieces (fixed value).
BLANK = "▁"

#: Words and characters that a worker's table may hold before it starts anew.
KEPT_WORDS = 500_000
KEPT_CHARS = 12_000_000

_NEVER = 1 << 40
_VERDICTS = 1 << 20  # places of the table of tested pairs


def last_merge(chars: str, ranks: dict[str, int]) -> tuple[str, str] | None:
    """The last two pieces that are joined when ``chars`` is encoded; None if more than one stays."""
    parts = list(chars)
    while len(parts) > 2:
        found = [(ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, i = min(found)
        if rank == _NEVER:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if "".join(parts) in ranks else None


class PieceModel:
    """What is known about prefixes by the pieces of a sentencepiece BPE file.

    The file must cut nothing before it joins (no normalisation, blanks as ``BLANK``, one in front), fall back
    to bytes, give every piece but runs of blanks its own priority, and have no piece with a blank inside; others
    raise ValueError.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as data:
            proto.ParseFromString(data.read())
        normal, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        pieces = [p for p in proto.pieces if p.type == kinds.NORMAL]
        if (
            proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback
            or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix
            or not normal.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)
        ):
            raise ValueError("this kind of piece model is not supported")
        self.runs = {len(p.piece) for p in pieces if set(p.piece) == {BLANK}}
        words = [p for p in pieces if p.piece.strip(BLANK)]
        longer = sorted((p for p in words if len(p.piece) > 1), key=lambda p: -p.score)
        inner = any(BLANK in p.piece[1:] for p in words)
        if inner or 1 not in self.runs or len({p.score for p in longer}) < len(longer):
            raise ValueError("this piece model has blanks inside pieces, or pieces of one priority")
        ranks = {p.piece: i for i, p in enumerate(longer)}
        number = {c: i for i, c in enumerate(sorted({c for p in words for c in p.piece} | {BLANK}), 1)}
        self._single = {p.piece for p in words if len(p.piece) == 1} | {BLANK}
        if set(number) != self._single:
            raise ValueError("this piece model has pieces of characters that are none")
        # Numbers of pieces: characters first, then what joins can give, in their order.
        merges = {p: last_merge(p, ranks) for p in ranks}
        alive = [*number, *[p for p in ranks if merges[p]]]
        piece = {p: i for i, p in enumerate(alive, 1)}
        self.rank = np.full(len(alive) + 1, -1, np.int64)
        self.halves = np.zeros((2, len(alive) + 1), np.int64)
        for p in alive[len(number) :]:
            left, right = merges[p]
            self.rank[piece[p]], self.halves[:, piece[p]] = ranks[p], (piece[left], piece[right])
            if max(ranks.get(left, -1), ranks.get(right, -1)) >= ranks[p]:
                raise ValueError("a piece is joined before its halves are")
        halves = [(p[:i], p[i:], r) for p, r in ranks.items() for i in range(1, len(p))]
        joins = [(piece[a], piece[b], r) for a, b, r in halves if a in piece and b in piece]
        left, right, self.join_rank = np.array(joins, np.int64).T
        self.joins = DoubleArray(left, right)
        self._characters(number, words)
        self._trie(number, piece)
        self.blank = piece[BLANK]
        self.run_counts, self._stack = [0], []
        self._asked, self._verdict = np.full(_VERDICTS, -1, np.int64), np.zeros(_VERDICTS, bool)

    def _characters(self, number: dict[str, int], words) -> None:
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in number]] = list(number.values())
        self.inside = np.zeros((len(number) + 1, len(number) + 1), bool)
        for p in words:
            n = [number[c] for c in p.piece]
            self.inside[n[:-1], n[1:]] = True

    def _trie(self, number: dict[str, int], piece: dict[str, int]) -> None:
        nodes, edges = {"": 0}, []
        ends = [0]
        for p in piece:
            for i in range(1, len(p) + 1):
                if p[:i] not in nodes:
                    nodes[p[:i]] = len(nodes)
                    edges.append((nodes[p[: i - 1]], number[p[i - 1]]))
                    ends.append(piece.get(p[:i], 0))
        self.trie, self.ends = DoubleArray(*np.array(edges, np.int64).T), np.array(ends, np.int64)

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two pieces are the encoding of the text they make together."""
        key = left << 32 | right
        at = (key * 0x9E3779B1 >> 13) & (_VERDICTS - 1)
        found, missed = self._verdict[at], np.flatnonzero(self._asked[at] != key)
        if len(missed):
            new, which = np.unique(key[missed], return_inverse=True)
            verdict = self._test(new >> 32, new & 0xFFFFFFFF)
            found[missed] = verdict[which]
            self._asked[at[missed]], self._verdict[at[missed]] = key[missed], verdict[which]
        return found

    def _test(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undo the joins of both from the last one on; neighbours on the way must not have joined earlier."""
        good, limit = np.ones(len(left), bool), np.full(len(left), _NEVER)
        going = np.arange(len(left))
        while len(going):
            x, y = left[going], right[going]
            edge = self.joins.step(x, y)
            good[going] &= ~((edge >= 0) & (self.join_rank[edge] < limit[going]))
            rank_x, rank_y = self.rank[x], self.rank[y]
            first = rank_x > rank_y
            left = left.copy()
            left[going] = np.where(first, self.halves[1, x], x)
            right = right.copy()
            right[going] = np.where(first, y, self.halves[0, y])
            # Of equal joins the left one is made first.
            limit[going] = np.where(first, rank_x, rank_y + 1)
            going = going[good[going] & (np.maximum(rank_x, rank_y) >= 0)]
        return good

    def of_run(self, n: int) -> int:
        """Tokens of ``n`` blanks alone."""
        while len(self.run_counts) <= n:
            self._stack.append(1)
            while len(self._stack) > 1 and self._stack[-1] + self._stack[-2] in self.runs:
                self._stack.append(self._stack.pop() + self._stack.pop())
            self.run_counts.append(len(self._stack))
        return self.run_counts[n]

    def prefixes(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every place of ``chars``: tokens since the last cut, whether those begin with a lone
        blank, and where that cut is. Runs of blanks are cut into single ones."""
        n = len(chars)
        kind = self.number[chars]
        cut = np.ones(n + 1, bool)
        cut[1:n] = ~self.inside[kind[:-1], kind[1:]]
        begin = np.maximum.accumulate(np.where(cut[:n], np.arange(n), 0))
        level = np.arange(n) - begin
        order = np.argsort(level, kind="stable")
        ends = np.cumsum(np.bincount(level)) if n else []
        count, lone, last = np.ones(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
        start = node = at = np.zeros(0, np.int64)
        done = 0
        for end in ends:
            fresh = order[done:end]
            done = end
            on = ~cut[at + 1]  # those that are not at the end of their part
            start, at = np.concatenate([start[on], fresh]), np.concatenate([at[on] + 1, fresh])
            node = self.trie.step(np.concatenate([node[on], np.zeros(len(fresh), np.int64)]), kind[at]) + 1
            going = node > 0
            start, at, node = start[going], at[going], node[going]
            piece = self.ends[node]
            some = np.flatnonzero(piece)
            s, p, t = start[some], at[some], piece[some]
            first = level[s] == 0
            before = np.maximum(s - 1, 0)
            fits = first.copy()
            fits[~first] = self.follows(last[before[~first]], t[~first])
            s, p, t, first, before = s[fits], p[fits], t[fits], first[fits], before[fits]
            last[p], count[p] = t, np.where(first, 1, count[before] + 1)
            lone[p] = np.where(first, t == self.blank, lone[before])
        unknown = np.flatnonzero(kind == 0)
        if (last[kind > 0] == 0).any():
            raise RuntimeError("a prefix has no last piece")
        width = chars[unknown]
        count[unknown] = 1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF)
        return count, lone, begin

    def count_words(self, words: list[str]) -> list[int]:
        """Twice the tokens of every word behind one blank, plus 1 if the first token is that blank."""
        if not words:
            return []
        chars = _characters_of(BLANK + BLANK.join(words))
        count, lone, begin = self.prefixes(chars)
        last = np.flatnonzero(np.append(begin[1:] != begin[:-1], True))  # ends of parts
        word = np.flatnonzero(chars[begin[last]] == ord(BLANK))
        return (2 * np.add.reduceat(count[last], word) + lone[last[word]]).tolist()

    def count_prefixes(self, text: str) -> np.ndarray:
        """Tokens of every prefix of a text, from that of no character to the whole."""
        if not text:
            return np.zeros(1, np.int64)
        chars = _characters_of(BLANK + text.replace(" ", BLANK))
        count, lone, begin = self.prefixes(chars)
        n, blank = len(chars), chars == ord(BLANK)
        place = np.arange(n)
        # Tokens from the last blank on, and whether they begin with it alone.
        part_end = np.append(begin[1:] != begin[:-1], True)
        passed = np.cumsum(np.where(part_end, count, 0))
        before_part = np.where(begin > 0, passed[np.maximum(begin - 1, 0)], 0)
        head = np.maximum.accumulate(np.where(blank, place, 0))
        here = before_part + count - np.where(head > 0, passed[np.maximum(head - 1, 0)], 0)
        ends = np.flatnonzero(part_end)
        alone = np.where(begin == head, lone, lone[ends[np.searchsorted(ends, head)]])
        # Runs of blanks: how many there are up to the head of a place.
        new_run = blank & ~np.append(False, blank[:-1])
        run_start = np.maximum.accumulate(np.where(new_run, place, 0))[head]
        run = head - run_start + 1
        self.of_run(int(run.max()))
        runs = np.array(self.run_counts)
        here += np.where(run == 1, 0, np.where(alone, runs[run] - 1, runs[run - 1]))
        # Units are a run and the word behind it; what is before a unit is the sum of their last places.
        unit_end = np.append(new_run[1:], True)
        total = np.cumsum(np.where(unit_end, here, 0))
        unit = np.maximum.accumulate(np.where(new_run, place, 0))
        result = here + np.where(unit > 0, total[np.maximum(unit - 1, 0)], 0)
        result[0] = 0
        return result


def _characters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    return PieceModel(path)


class Counter:
    """Token counts of whole texts."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.table: dict[str, int] = {}
        self.chars = 0

    def __call__(self, texts: list[str]) -> list[int]:
        split = [t.replace(BLANK, " ").split(" ") if t else [] for t in texts]
        if len(self.table) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.table.clear()
            self.chars = 0
        new = list(set().union(*split).difference(self.table))
        new = [w for w in new if w]
        self.table.update(zip(new, self.model.count_words(new)))
        self.chars += sum(map(len, new))
        self.table[""] = -1
        return [self._sum(words) for words in split]

    def _sum(self, words: list[str]) -> int:
        known = [self.table[w] for w in words]
        if -1 not in known:
            return sum([k >> 1 for k in known])
        total, run = 0, 0
        for k in known:
            run += 1
            if k >= 0:
                alone = run > 1 and k & 1
                total += (k >> 1) + (self.model.of_run(run) - 1 if alone else self.model.of_run(run - 1))
                run = 0
        return total + self.model.of_run(run)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text", prefixes: bool = False
) -> DataFrame:
    """key, n_bytes, n_tokens and limit_chars of every row, and on request the counts of all its prefixes.

    ``limit_chars`` is the length in characters of the longest prefix of at most ``limit`` tokens.
    ``prefix_tokens`` (array<int>) holds the count of the prefix of ``i`` characters at place ``i``, from 0 on:
    store it, and :func:`tokens_of` and :func:`longest_prefix` answer every later question.

    One row per input row, in any order: repeated rows are counted as often as they occur, a null key stays null,
    null and empty texts have no tokens, an empty table gives an empty result, other columns are not read. The
    text is taken whole, however long.
    """

    def make():
        model = load_model(path)
        counter = Counter(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = counter(texts)
            within = [
                len(t) if n <= limit and not prefixes else int(np.flatnonzero(model.count_prefixes(t) <= limit)[-1])
                for t, n in zip(texts, counts)
            ]
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            columns = [batch.column("key"), n_bytes, pa.array(counts, pa.int64()), pa.array(within, pa.int64())]
            names = ["key", "n_bytes", "n_tokens", "limit_chars"]
            if prefixes:
                every = [model.count_prefixes(t).astype(np.int32) for t in texts]
                columns.append(pa.array(every, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            return pa.RecordBatch.from_arrays(columns, names)

        return work

    schema = f"key {arrow_type(docs, key)}, n_bytes long, n_tokens long, limit_chars long"
    schema += ", prefix_tokens array<int>" if prefixes else ""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_texts(slim, make, schema).withColumnRenamed("key", key)


def tokens_of(prefix_tokens: str | Column, n_chars: int | Column) -> Column:
    """Tokens of the text cut after ``n_chars`` characters; of the whole text if it has fewer."""
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    n_chars = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(counts, F.least(n_chars + 1, F.size(counts)).cast("int"))


def longest_prefix(prefix_tokens: str | Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens.

    A character more can mean a token less, so the last fitting place counts, not the first one too many.
    """
    counts = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i)))


def op11_tokens(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "limit_chars"
    )
