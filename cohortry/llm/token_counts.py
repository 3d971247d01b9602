"""Exact token counts at every prefix (operator 8).

For a byte-pair vocabulary the encoding of a prefix ends in exactly one token, so its count is one more than that of the prefix
before that token. The dynamic program goes over the ends of a text; a token may stand last if the pair of the last token
before it and itself encodes to just that pair. One signed byte per character is stored, the change of the count, and answers
how many tokens any prefix has and where a budget is used up, without encoding again.

No piece of the vocabulary contains a blank after another character, or a line feed (checked on loading), so a text falls into
units at those places that do not influence each other; a unit is computed once and remembered.

Defined results
    NULL and empty texts have no tokens and no prefixes. Strings that look like special tokens are ordinary text. Repeated rows
    are counted alike; an empty table gives an empty result. Only the identifier and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import UnitCache

_BLANK = "▁"
_UNIT = re.compile(f"\n|{_BLANK}*[^{_BLANK}\n]+|{_BLANK}+")


class PrefixCounter:
    """Counts of every prefix, for a SentencePiece byte-pair model without normalisation."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(len(model)) if not special(i)}
        if any(re.search(f"[^{_BLANK}]{_BLANK}|\n", p) for p in self.score):
            raise ValueError("pieces of this vocabulary cross the edges of units")
        self.longest = max(map(len, self.score))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.cache = UnitCache(lambda units: [self.unit(self._text(u)) for u in units])

    @staticmethod
    def _text(key: str) -> str:
        return key if key[:1] == "\n" else _BLANK + key

    def _merge(self, text: str) -> list[str]:
        """The encoding by its definition: the best adjacent pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best = max(((score[p], -i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stands(self, before: str, token: str) -> bool:
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[key] = self._merge(before + token) == [before, token]
        return known

    def _alone(self, token: str) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self._merge(token) == [token]
        return known

    def unit(self, text: str) -> bytes:
        """Change of the count with every character, one signed byte each."""
        score, longest, pairs = self.score, self.longest, self.pairs
        last, count, out = [""], [0], bytearray()
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                token = text[start:end]
                if token in score:
                    if start == 0:
                        fits = self._alone(token)
                    else:
                        before = last[start]
                        fits = pairs.get((before, token))
                        if fits is None:
                            fits = self._alone(token) and self._stands(before, token)
                    if fits:
                        n = count[start] + 1
                        break
            else:
                # a character outside the vocabulary: its bytes
                token, n = text[end - 1], count[end - 1] + (1 if text[end - 1] in score else len(text[end - 1].encode()))
            out.append((n - count[-1]) & 255)
            last.append(token)
            count.append(n)
        return bytes(out)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """For each text a signed byte per character: by how much its count changes with that character."""
        odd = [t[:1] in (" ", "\n") or "  " in t or _BLANK in t for t in texts]
        plain = [None if o else t.replace("\n", " \n").split(" ") for t, o in zip(texts, odd)]
        table = self.cache.table([u for p in plain if p for u in p if u or len(p) > 1])
        out = []
        for text, parts in zip(texts, plain):
            if not text:
                out.append(b"")
            elif parts is None:
                units = [self.unit(u) for u in _UNIT.findall(_BLANK + text.replace(" ", _BLANK))]
                out.append(self._begin(units))
            else:
                # the blank before a line feed is not in the text; the unit of a key that begins with one has no blank either
                out.append(self._begin(list(map(table.__getitem__, parts))))
        return out

    @staticmethod
    def _begin(units: list[bytes]) -> bytes:
        """The first unit begins with a blank that the text does not have: its change counts with the next character."""
        joined = b"".join(units)
        return bytes([(joined[0] + joined[1]) & 255]) + joined[2:]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for all tasks of a worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_counts(docs: DataFrame, path: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, prefix (binary, a signed byte per character), n_tokens, cut (characters that fit the budget)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                steps = count(texts)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(steps, pa.binary()),
                    pa.array([tokens_at(s, len(s)) for s in steps], pa.int64()), pa.array([cut_at(s, budget) for s in steps], pa.int64())],
                    names=["doc_id", "n_bytes", "prefix", "n_tokens", "cut"])
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        of, "doc_id long, n_bytes long, prefix binary, n_tokens long, cut long")


def tokens_at(prefix: bytes, chars: int) -> int:
    """Exact number of tokens of the first ``chars`` characters."""
    return int(np.frombuffer(prefix, np.int8)[:chars].sum(dtype=np.int64))


def cut_at(prefix: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(prefix, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def over(n_tokens: Column, budget: int = 4096) -> Column:
    return n_tokens > budget
