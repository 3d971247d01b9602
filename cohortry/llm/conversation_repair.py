"""Repair of conversation structure with a persistent audit of its edits (operator 12).

A conversation is repaired when the initials of its roles match ``(s?(ua)+)?``. A dynamic program over its rows keeps, for each
state of that pattern, the cheapest edits that lead there. The edits so far are a node of a tree that all candidates share
(:class:`Trail`): a node knows its letter, its ancestors at powers of two and a rolling hash. Of equally cheap candidates the
audit that is least in ASCII stays; two audits are compared by a search for their longest common prefix over the ancestors.
Equal hashes are verified: nodes are shared by letter and parent, so equal audits are the same node.

A conversation may hold any share of the rows. Rows are ordered by conversation and turn over ranges, and cut into blocks of
``BLOCK`` rows by their place. In a block the program runs from every state in which the conversation can enter it, which gives
the cheapest edits from each state to each; blocks of one conversation are then chained, again a dynamic program, over their
packed summaries. A row repeats an earlier one if it has not the first place of its role and text; places are unique, so that
no text is a hot key. The repaired text is hashed in order while it streams past; only the audit, one value, is held.

Defined results
    NULL counts as one space in the damage, in roles and in texts; a NULL turn comes first and does not count in the gaps. Rows of
    one turn are ordered by role, then by the SHA-256 of role and text. Rows with a NULL conversation form one conversation.
    A role without a first letter, or with another one than s, u or a, can only be renamed or deleted. Conversations without
    a row have zeros, an empty audit and the hash of the empty text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, stored

BLOCK_BITS = 12
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state after a role that is put in, from each state
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Costs:
    rename: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Trail:
    """Strings that share their beginnings: node 0 is the empty one, every other adds a letter to its parent."""

    _PRIME, _BASE = (1 << 61) - 1, 911_382_323

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [[]]
        self.children: dict[tuple[int, str], int] = {}

    def push(self, node: int, letter: str) -> int:
        known = self.children.get((node, letter))
        if known is not None:
            return known
        new = self.children[node, letter] = len(self.letter)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self._BASE + ord(letter)) % self._PRIME)
        above, k = [node], 0
        while k < len(self.up[above[k]]):
            above.append(self.up[above[k]][k])
            k += 1
        self.up.append(above)
        return new

    def same(self, a: int, b: int) -> bool:
        """Unequal hashes tell strings apart; equal ones are verified by the node, which equal strings share."""
        return self.hash[a] == self.hash[b] and a == b

    def lift(self, node: int, depth: int) -> int:
        """The beginning of that length."""
        while self.depth[node] > depth:
            step = (self.depth[node] - depth).bit_length() - 1
            node = self.up[node][step]
        return node

    def less(self, a: int, b: int) -> bool:
        short = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, short), self.lift(b, short)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]) and not self.same(self.up[x][k], self.up[y][k]):
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _edits(symbol: str, state: int, costs: Costs) -> Iterator[tuple[str, int, int]]:
    """(letter, next state, cost) of what can be done with a row. Symbols are initials, in capitals where the text is truncated;
    ``x`` is any other initial, ``d`` a row that must go."""
    yield "D", state, costs.delete
    if symbol != "d":
        more = costs.truncated if symbol.isupper() else 0
        kept = _KEPT.get((state, symbol.lower()))
        if kept is not None:
            yield "K", kept, more
        yield "R", _NEXT[state], costs.rename + more


@lru_cache(maxsize=20_000)
def paths(symbols: str, start: int, costs: Costs = Costs()) -> dict[int, tuple[int, str]]:
    """The cheapest edits of a run of rows from a state to every state: {end: (cost, audit)}."""
    trail = Trail()

    def offer(at: dict[int, tuple[int, int]], state: int, cost: int, node: int, letter: str) -> bool:
        have = at.get(state)
        if have is not None and have[0] < cost:
            return False
        new = trail.push(node, letter)
        if have is None or cost < have[0] or trail.less(new, have[1]):
            at[state] = cost, new
            return True
        return False

    def with_inserts(at: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        while any([offer(at, _NEXT[s], c + costs.insert, n, "I") for s, (c, n) in list(at.items())]):
            pass
        return at
    best = with_inserts({start: (0, 0)})
    for symbol in symbols:
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in best.items():
            for letter, to, more in _edits(symbol, state, costs):
                offer(after, to, cost + more, node, letter)
        best = with_inserts(after)
    return {s: (c, trail.text(n)) for s, (c, n) in best.items()}


class _Link:
    """A summary of a block appended to those before it."""

    __slots__ = ("up", "audit", "depth")

    def __init__(self, before: "_Link | None", audit: str):
        self.audit, self.depth = audit, before.depth + 1 if before else 0
        self.up, k = [before] if before else [], 0
        while self.up and k < len(self.up[k].up):
            self.up.append(self.up[k].up[k])
            k += 1

    def below(self, depth: int) -> str:
        """The audit after the first ``depth`` links."""
        parts, link = [], self
        while link.depth > depth:
            parts.append(link.audit)
            link = link.up[0]
        return "".join(reversed(parts))

    def less(self, other: "_Link") -> bool:
        """Both have the same depth. The audits differ after the last link that both share."""
        x, y = self, other
        for k in reversed(range(len(x.up))):
            if k < len(x.up) and x.up[k] is not y.up[k]:
                x, y = x.up[k], y.up[k]
        if not (x.audit.startswith(y.audit) or y.audit.startswith(x.audit)):
            return x.audit < y.audit
        return self.below(x.depth - 1) < other.below(x.depth - 1)


def _chained(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from its blocks' (from, to, cost, audit), in order."""
    root = _Link(None, "")
    best: dict[int, tuple[int, _Link]] = {START: (0, root)}
    for piece in pieces:
        after: dict[int, tuple[int, _Link]] = {}
        links: dict[tuple[int, str], _Link] = {}
        for a, b, cost, audit in piece:
            if a not in best:
                continue
            cost += best[a][0]
            have = after.get(b)
            if have is not None and have[0] < cost:
                continue
            key = id(best[a][1]), audit
            link = links[key] if key in links else links.setdefault(key, _Link(best[a][1], audit))
            if have is None or cost < have[0] or (link is not have[1] and link.less(have[1])):
                after[b] = cost, link
        best = after
    ends = [best[s] for s in (START, ASSISTANT) if s in best]
    cost = min(c for c, _ in ends)
    return cost, min(link.below(0) for c, link in ends if c == cost)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the checksum of ``conv_id:turn`` chooses."""
    written = [F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(written[0], F.lit(":"), written[1])) % 20
    text, role = (F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("text", "role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    marked = rows.select(rows["conv_id"], rows["turn"], rows["role"], rows["text"]).withColumn("kind", kind).filter("kind <> 0")
    return marked.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"), text.alias("text"),
                         F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _marked(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    mark = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), mark.alias("mark"))


PIECE = ("block long, opens boolean, closes boolean, blank long, duplicate long, truncated long, illegal long, first string, last string,"
         " first_turn long, last_turn long, turns long, paths array<struct<a:int,b:int,cost:long,audit:binary>>")


def _piece(rows: list[tuple], opens: bool, closes: bool, costs: Costs) -> dict:
    """Summary of consecutive rows (turn, initial, blank, truncated, repeats) of one conversation."""
    symbols, blank, duplicate, truncated = [], 0, 0, 0
    for _, initial, empty, cut, repeats in rows:
        blank += empty
        duplicate += repeats and not empty
        truncated += cut and not repeats and not empty
        letter = initial if initial and initial in "sua" else "x"
        symbols.append("d" if empty or repeats else letter.upper() if cut else letter)
    symbols = "".join(symbols)
    ways = [(a, b, c, audit) for a in ((START,) if opens else range(4)) for b, (c, audit) in paths(symbols, a, costs).items()]
    if opens and closes:
        least = min((c, audit) for _, b, c, audit in ways if b in (START, ASSISTANT))
        ways = [(START, ASSISTANT if least[1].strip("D") else START, *least)]
    known = [r[0] for r in rows if r[0] is not None]
    initials = [r[1] for r in rows]
    return {"opens": opens, "closes": closes, "blank": blank, "duplicate": duplicate, "truncated": truncated,
            "illegal": sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)),
            "paths": [{"a": a, "b": b, "cost": c, "audit": zlib.compress(audit.encode(), 1) if not (opens and closes) else audit.encode()} for a, b, c, audit in ways]}


def _joined(pieces: list[dict]) -> dict:
    """The conversation of its pieces, in order."""
    alone = len(pieces) == 1 and pieces[0]["opens"] and pieces[0]["closes"]
    if alone:
        cost, audit = pieces[0]["paths"][0]["cost"], pieces[0]["paths"][0]["audit"].decode()
    else:
        cost, audit = _chained([[(p["a"], p["b"], p["cost"], zlib.decompress(p["audit"]).decode()) for p in piece["paths"]] for piece in pieces])
    out = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(p["last"] + q["first"] not in _LEGAL for p, q in zip(pieces, pieces[1:]))
    known = [p for p in pieces if p["first_turn"] is not None]
    turns = sum(p["turns"] for p in known) - sum(p["last_turn"] == q["first_turn"] for p, q in zip(known, known[1:]))
    return out | {"gaps": known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0, "cost": cost, "audit": audit}


VERDICT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def audits(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    bare = F.btrim("text", F.lit(BLANKS))
    narrow = _marked(turns).select("conv_id", "turn", "role", "mark", F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("blank"),
                                   (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("own"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "mark", "own")]
    places = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "mark", "initial", "blank", "cut")
    places = stored(places.withColumn("place", F.monotonically_increasing_id()), "places")
    firsts = places.groupBy("conv_id", "mark").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    known = places.drop("mark").join(firsts, "place", "left").withColumn("block", F.shiftright("place", BLOCK_BITS))
    own = turns.schema["conv_id"].dataType.simpleString()
    names = ["place", "conv_id", "turn", "initial", "blank", "cut", "first"]

    def summarise(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        kind = table.schema.field("conv_id")
        rows = list(zip(*(table.column(c).to_pylist() for c in names[1:])))
        out = []
        runs = [list(g) for _, g in groupby(rows, key=lambda r: (r[0] is None, r[0]))]
        for i, run in enumerate(runs):
            lines = [(t, initial, blank, cut, not first) for _, t, initial, blank, cut, first in run]
            out.append({"conv_id": run[0][0], "block": key[0].as_py()} | _piece(lines, i > 0, i < len(runs) - 1, costs))
        return _arrow(out, pa.schema([kind, *_piece_fields()]))

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        pieces = sorted(table.to_pylist(), key=lambda p: p["block"])
        return _arrow([{"conv_id": pieces[0]["conv_id"]} | _joined(pieces)], pa.schema([table.schema.field("conv_id"), *_verdict_fields()]))
    pieces = stored(known.select("block", *names).groupBy("block").applyInArrow(summarise, f"conv_id {own}, {PIECE}"), "pieces")
    # a conversation inside one block needs no other
    whole = F.col("opens") & F.col("closes")
    single = F.col("paths")[0]
    alone = pieces.filter(whole).select("conv_id", F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).cast("long").alias("gaps"),
                                        "blank", "duplicate", "truncated", "illegal", single["cost"].alias("cost"), single["audit"].cast("string").alias("audit"))
    return alone.union(pieces.filter(~whole).groupBy("conv_id").applyInArrow(joined, f"conv_id {own}, {VERDICT}"))


def _piece_fields() -> list[pa.Field]:
    way = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.binary())])
    return [pa.field("block", pa.int64()), pa.field("opens", pa.bool_()), pa.field("closes", pa.bool_()), *(pa.field(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")),
            pa.field("first", pa.string()), pa.field("last", pa.string()), *(pa.field(c, pa.int64()) for c in ("first_turn", "last_turn", "turns")), pa.field("paths", pa.list_(way))]


def _verdict_fields() -> list[pa.Field]:
    return [*(pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), pa.field("audit", pa.string())]


class Replay:
    """Applies an audit to the rows of a conversation as they come: yields (role, text) of the repaired ones."""

    _ROLE = {USER: "user", ASSISTANT: "assistant"}

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield self._ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEPT[self.state, role[:1]]
            yield role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield self._ROLE[self.state], text


def repair(turns: DataFrame, conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per conversation of ``conversations`` (conv_id): the faults of its rows in ``turns``, the cheapest edits and the
    SHA-256 of the repaired conversation. Texts are shuffled once, and streamed."""
    verdicts = stored(audits(turns, costs), "audits")
    own = turns.schema["conv_id"].dataType.simpleString()
    fields = [f.strip().split()[0] for f in VERDICT.split(",")]
    none = {c: F.lit(None).cast(t) for c, t in (f.strip().split() for f in VERDICT.split(","))}
    line = {"turn": "long", "role": "string", "mark": "binary", "text": "string"}
    empty = [F.lit(None).cast(t).alias(c) for c, t in line.items()]
    parts = [verdicts.select("conv_id", F.lit(0).alias("kind"), *fields, *empty),
             conversations.select("conv_id").distinct().select("conv_id", F.lit(1).alias("kind"), *[none[c].alias(c) for c in fields], *empty),
             _marked(turns).select("conv_id", F.lit(2).alias("kind"), *[none[c].alias(c) for c in fields], *line)]
    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "turn", "role", "mark")]
    lines = parts[0].union(parts[1]).union(parts[2]).repartition("conv_id").sortWithinPartitions(*order).drop("mark", "turn")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, verdict, digest, replay, first, out, kind = None, None, None, None, True, [], None

        def put(some: Iterator[tuple[str, str]]) -> None:
            nonlocal first
            for role, text in some:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False

        def close() -> None:
            if now is not None:
                put(replay.inserts())
                out.append({"conv_id": now[1]} | verdict | {"repaired_sha256": digest.hexdigest()})
        schema = None
        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field("conv_id"), *_verdict_fields(), pa.field("repaired_sha256", pa.string())])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", *fields)]
            for conv, kind, role, text, *judged in zip(*columns):
                if now is None or (conv is None, conv) != now:
                    close()
                    now, digest, first = (conv is None, conv), hashlib.sha256(), True
                    verdict = dict.fromkeys(fields, 0) | {"audit": ""} if kind else dict(zip(fields, judged))
                    replay = Replay(verdict["audit"])
                if kind == 2:
                    put(replay.row(role, text))
            if out:
                yield from _arrow(out, schema).to_batches()
                out.clear()
        close()
        if out:
            yield from _arrow(out, schema).to_batches()
    made = lines.mapInArrow(hashed, f"conv_id {own}, {VERDICT}, repaired_sha256 string")
    return made.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
