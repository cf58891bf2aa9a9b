"""Repair of conversation structure by a rank-convergence parallel Viterbi search.

The cheapest edits that make the roles of a conversation read ``(s?(ua)+)?`` are a shortest path through four
states (nothing yet, after a system turn, after a user turn, after an assistant turn). Its costs to go are a
vector of four numbers at each row, computed from the end. Following Maleki, Musuvathi and Mytkowicz (2014):

1. every chunk of a conversation computes its vectors from a speculative vector at its end (the last from the true one);
2. fix-up passes hand each chunk the vector its right neighbour now begins with. Where it differs by more than a
   constant from the one used, the chunk is walked again, until its vector differs only by a constant from the old one there:
   from that row on to the left everything holds. A pass without such chunks is the last;
3. with the stitched costs each chunk knows in which state it leaves off for each state it is entered in; these maps are
   composed over blocks of chunks, and each chunk then traces the ASCII-least cheapest edits from its true state.

Vectors less their least entry take few values, so steps are looked up by (vector, kind of row). Rows that must be deleted
add the same to every state and are left out of the search. Passes are at most the chunks of the longest run that
keeps two vectors apart, and one when no conversation is longer than a chunk.

Rows are ordered by turn (nulls first), then role, then text. Null roles and texts read as one space, a null turn counts
for no gap, rows with a null conv_id are one conversation. A role without a first character is of no legal kind. Repeated
rows are duplicates, also where they repeat a third of a table. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapegrain.llm import turns
from tapegrain.llm.common import materialize

#: Costs of the edits, in the order of ties: delete, insert, keep, give another role; and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant. The state that a user or assistant row leads to:
FORCED_NEXT = (2, 2, 3, 2)
LEGAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
KINDS = "sua"
ROLE = {2: "user", 3: "assistant"}
#: Code of a row: its initial (s, u, a, other), plus 4 if truncated; GONE if it must be deleted.
GONE = 8
INF = 1 << 30
_ENDS = (".", "!", "?")
_SPACE = " \t\n\v\f\r"
PAIRS = frozenset(("su", "ua", "au"))
#: Chunks whose state maps are composed by one task.
BLOCK = 1024


def _closed(raw: tuple[int, ...]) -> tuple[int, ...]:
    """Costs with any rows inserted first."""
    u, a = min(raw[2], INSERT + raw[3]), min(raw[3], INSERT + raw[2])
    return min(raw[0], INSERT + u), min(raw[1], INSERT + u), u, a


END = _closed((0, INF, INF, 0))
GUESS = (0, 0, 0, 0)


class Steps:
    """Vectors by number, and the steps between them, computed once each."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.before: dict[int, int] = {}
        self.edits: dict[int, tuple[str, tuple[int, ...], int]] = {}

    def of(self, vector) -> int:
        vector = tuple(int(x) for x in vector)
        low = min(vector)
        vector = tuple(x - low for x in vector)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    @staticmethod
    def _options(after: tuple[int, ...], code: int, q: int) -> tuple[int, int, int]:
        """Costs of delete, keep, rerole in state q."""
        stay = TRUNCATED * (code >> 2)
        kept = LEGAL[q].get(KINDS[code & 3]) if code & 3 < 3 else None
        return DELETE + after[q], INF if kept is None else stay + after[kept], REROLE + stay + after[FORCED_NEXT[q]]

    def back(self, v: int, code: int) -> int:
        """Vector before a row, from the one after it."""
        key = v * 8 + code
        found = self.before.get(key)
        if found is None:
            found = self.before[key] = self.of(_closed(tuple(min(self._options(self.vectors[v], code, q)) for q in range(4))))
        return found

    def edit(self, v: int, code: int, q: int) -> tuple[str, tuple[int, ...], int]:
        """The least cheapest edits at a row in state q, given the vector after it: letters, states of inserted rows, next state."""
        key = (v * 8 + code) * 4 + q
        found = self.edits.get(key)
        if found is None:
            after = self.vectors[v]
            raw = [self._options(after, code, s) for s in range(4)]
            cost = _closed(tuple(min(r) for r in raw))
            letters, added = "", []
            while True:
                delete, keep, rerole = raw[q]
                if delete == cost[q]:
                    found = (letters + "D", tuple(added), q)
                elif INSERT + cost[FORCED_NEXT[q]] == cost[q]:
                    letters, q = letters + "I", FORCED_NEXT[q]
                    added.append(q)
                    continue
                elif keep == cost[q]:
                    found = (letters + "K", tuple(added), LEGAL[q][KINDS[code & 3]])
                else:
                    found = (letters + "R", tuple(added), FORCED_NEXT[q])
                break
            self.edits[key] = found
        return found

    def walk(self, codes: bytes, v: int) -> int:
        """Vector before all rows."""
        before = self.before
        for code in reversed(codes.translate(None, bytes([GONE]))):
            found = before.get(v * 8 + code)
            v = self.back(v, code) if found is None else found
        return v

    def fix(self, codes: bytes, old: int, new: int, begin: int) -> int:
        """As ``walk`` from ``new``, given that the walk from ``old`` came to ``begin``: ends where both agree."""
        for code in reversed(codes.translate(None, bytes([GONE]))):
            if old == new:
                return begin
            old, new = self.back(old, code), self.back(new, code)
        return new

    def path(self, codes: bytes, v: int) -> list[int]:
        """Vector after each row."""
        out = [0] * len(codes)
        for i in range(len(codes) - 1, -1, -1):
            out[i] = v
            if codes[i] != GONE:
                v = self.back(v, codes[i])
        return out

    def leave(self, codes: bytes, v: int) -> list[int]:
        """For each state at the first row the state after the last."""
        now = [0, 1, 2, 3]
        for code, after in zip(codes, self.path(codes, v)):
            if code != GONE:
                now = [self.edit(after, code, q)[2] for q in now]
        return now


_steps = Steps()  # one in each worker


def fault_code(role: str, text: str) -> tuple[int, bool]:
    """(code of a row that is no duplicate, whether it is blank)."""
    solid = text.rstrip(_SPACE)
    kind = KINDS.find(role[:1]) if role[:1] else -1
    return (kind if kind >= 0 else 3) + (0 if solid.endswith(_ENDS) else 4), not solid


def _key(role: str, text: str) -> bytes:
    return hashlib.sha256(b"%d:" % len(role) + f"{role}{text}".encode("utf-8", "surrogatepass")).digest()


def _facts(rows: list) -> tuple:
    """What a chunk says of itself: codes with duplicates inside it, role edges, turns, and the rows."""
    seen, codes, keys, blank = set(), bytearray(), [], 0
    for _, role, text in rows:
        code, empty = fault_code(role, text)
        key = (role, text)
        if empty:
            blank += 1
            code = GONE
        elif key in seen:
            code = GONE
        else:
            seen.add(key)
            keys.append(len(codes))
        codes.append(code)
    roles = [r for _, r, _ in rows]
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in PAIRS for a, b in zip(initials, initials[1:]))
    whens = [t for t, _, _ in rows if t is not None]
    distinct = 0 if not whens else 1 + sum(a != b for a, b in zip(whens, whens[1:]))
    return (bytes(codes), blank, illegal, initials[0], initials[-1], distinct, whens[0] if whens else None, whens[-1] if whens else None, roles, [t for _, _, t in rows])


_COLUMNS = [("codes", pa.binary()), ("blank", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("turns", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()),
            ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
_DDL = "codes binary, blank long, illegal long, head string, tail string, turns long, lo long, hi long, roles array<string>, texts array<string>"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and place of each row that is the first of its kind in its chunk."""
    for batch in batches:
        ids, g, at, digest = [], [], [], []
        for conv, number, codes, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "g", "codes", "roles", "texts"))):
            for i, code in enumerate(codes):
                if code != GONE:
                    ids.append(conv)
                    g.append(number)
                    at.append(i)
                    digest.append(_key(roles[i], texts[i]))
        yield pa.record_batch({"conv_id": pa.array(ids, pa.int64()), "g": pa.array(g, pa.int64()), "at": pa.array(at, pa.int32()), "digest": pa.array(digest, pa.binary())})


def _without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes of a chunk with rows that an earlier chunk holds marked; ``places`` are the rows that stay."""
    for batch in batches:
        out = []
        for codes, places in zip(batch["codes"], batch["places"]):
            stay = np.zeros(len(codes), bool)
            if places is not None:
                stay[np.asarray(places, np.int64)] = True
            out.append(np.where(stay, np.frombuffer(codes, np.uint8), GONE).astype(np.uint8).tobytes())
        yield batch[["g", "first", "last"]].assign(codes=out)


def _guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        at_end = [END if last else GUESS for last in batch["last"]]
        begin = [_steps.vectors[_steps.walk(c, _steps.of(v))] for c, v in zip(batch["codes"], at_end)]
        yield pd.DataFrame({"g": batch["g"], "at_end": at_end, "at_begin": begin})


def _fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        begin = [_steps.vectors[_steps.fix(c, _steps.of(old), _steps.of(new), _steps.of(b))] for c, old, new, b in zip(batch["codes"], batch["at_end"], batch["wanted"], batch["at_begin"])]
        yield pd.DataFrame({"g": batch["g"], "at_end": batch["wanted"], "at_begin": begin})


def stitched(chunks: DataFrame) -> DataFrame:
    """(g, at_end): the true costs, less a constant, at the end of each chunk of (g, first, last, codes)."""
    schema = "g long, at_end array<int>, at_begin array<int>"
    now = materialize(chunks.select("g", "last", "codes").mapInPandas(_guess, schema), "costs")
    while True:
        right = now.join(chunks.select("g", "first"), "g").where("not first").select((F.col("g") - 1).alias("g"), F.col("at_begin").alias("wanted"))
        wrong = materialize(now.join(right, "g").where("at_end <> wanted"), "wrong")
        if wrong.isEmpty():
            return now.select("g", "at_end")
        fixed = wrong.join(chunks.select("g", "codes"), "g").mapInPandas(_fix, schema)
        now = materialize(now.join(wrong.select("g"), "g", "left_anti").unionByName(fixed), "costs")


def _leave(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        maps = [_steps.leave(c, _steps.of(v)) for c, v in zip(batch["codes"], batch["at_end"])]
        yield pd.DataFrame({"g": batch["g"], "map": [[m[0]] * 4 if first else m for first, m in zip(batch["first"], maps)]})


def _compose(group: pd.DataFrame) -> pd.DataFrame:
    now = [0, 1, 2, 3]
    for m in group.sort_values("g")["map"]:
        now = [int(m[q]) for q in now]
    return pd.DataFrame({"g": group["block"].iloc[:1], "map": [now]})


def _enter(group: pd.DataFrame) -> pd.DataFrame:
    group, q, out = group.sort_values("g"), int(group["entry"].iloc[0]), []
    for m in group["map"]:
        out.append(q)
        q = int(m[q])
    return pd.DataFrame({"g": group["g"], "entry": out})


def entered(maps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(g, entry): the state that the chunks before each chunk of (g, map) lead to; the map of a first chunk is constant."""
    blocked = maps.withColumn("block", F.floor(F.col("g") / block))
    over = materialize(blocked.groupBy("block").applyInPandas(_compose, "g long, map array<int>"), "maps")
    if over.limit(2).count() < 2:
        entry = over.select(F.col("g").alias("block"), F.lit(0).alias("entry"))
    else:
        entry = entered(over, block).withColumnRenamed("g", "block")
    return blocked.join(entry, "block").groupBy("block").applyInPandas(_enter, "g long, entry int")


def _trace(codes: bytes, at_end, q: int, last: bool, roles: list[str], texts: list[str]) -> tuple[str, int, int, list[str], list[str]]:
    """(audit, cost, truncated rows, repaired roles, repaired texts) of a chunk entered in state q."""
    letters, cost, out_roles, out_texts = [], 0, [], []
    for i, (code, after) in enumerate(zip(codes, _steps.path(codes, _steps.of(at_end)))):
        if code == GONE:
            letters.append("D")
            cost += DELETE
            continue
        edit, added, q = _steps.edit(after, code, q)
        letters.append(edit)
        cost += INSERT * len(added)
        out_roles.extend(ROLE[s] for s in added)
        out_texts.extend("" for _ in added)
        if edit[-1] == "D":
            cost += DELETE
            continue
        cost += REROLE * (edit[-1] == "R") + TRUNCATED * (code >> 2)
        out_roles.append(ROLE[q] if edit[-1] == "R" else roles[i])
        out_texts.append(texts[i])
    while last and q in (1, 2):
        q = FORCED_NEXT[q]
        letters.append("I")
        cost += INSERT
        out_roles.append(ROLE[q])
        out_texts.append("")
    return "".join(letters), cost, sum(4 <= c < GONE for c in codes), out_roles, out_texts


_PIECE = pa.schema([("conv_id", pa.int64()), ("g", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
                    ("illegal", pa.int64()), ("turns", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_PIECE_DDL = ("conv_id long, g long, first boolean, last boolean, n long, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long, cost long, audit string, "
              "roles array<string>, texts array<string>")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "g", "first", "last", "codes", "blank", "illegal", "turns", "lo", "hi", "at_end", "entry", "roles", "texts")
    out = turns.Batcher(_PIECE)
    for batch in batches:
        for conv, g, first, last, codes, blank, illegal, distinct, lo, hi, at_end, entry, roles, texts in zip(*(batch.column(c).to_pylist() for c in names)):
            audit, cost, cut, new_roles, new_texts = _trace(codes, at_end, entry, last, roles, texts)
            out.add((conv, g, first, last, len(codes), blank, codes.count(GONE) - blank, cut, illegal, distinct, lo, hi, cost, audit, new_roles, new_texts), sum(map(len, new_texts)))
            if out.full:
                yield out.take()
    yield out.take()


def pieces(rows: DataFrame, most_rows: int = turns.CHUNK_ROWS, most_bytes: int = turns.CHUNK_BYTES) -> DataFrame:
    """Every chunk with its counts, audit and repaired rows; ``rows`` as from ``turns.rows_of``.

    ``illegal`` and ``turns`` count also what lies between a chunk and the one before it in the same conversation.
    """
    chunks = turns.chunked(rows, _facts, _COLUMNS, _DDL, "turns", most_rows, most_bytes)
    whole, cut = F.col("first") & F.col("last"), ~(F.col("first") & F.col("last"))
    end = F.array(*[F.lit(x) for x in END])
    alone = chunks.where(whole).withColumns({"at_end": end, "entry": F.lit(0)})
    columns = alone.columns
    longer = chunks.where(cut)
    if longer.isEmpty():
        return alone.mapInArrow(_pieces, _PIECE_DDL)
    # rows that stand in an earlier chunk: the first place of each row, handed back to its chunk
    places = longer.select("conv_id", "g", "codes", "roles", "texts").mapInArrow(_keys, "conv_id long, g long, at int, digest binary")
    stay = places.groupBy("conv_id", "digest").agg(F.min(F.struct("g", "at")).alias("p")).groupBy(F.col("p.g").alias("g")).agg(F.collect_list("p.at").alias("places"))
    light = longer.select("g", "first", "last", "codes").join(stay, "g", "left")
    coded = materialize(light.mapInPandas(_without, "g long, first boolean, last boolean, codes binary"), "codes")
    costs = materialize(coded.join(stitched(coded), "g"), "stitched")
    entry = entered(costs.select("g", "first", "codes", "at_end").mapInPandas(_leave, "g long, map array<int>"))
    known = materialize(costs.select("g", "codes", "at_end").join(entry, "g"), "known").withColumnRenamed("entry", "left")
    before = longer.select((F.col("g") + 1).alias("g"), F.col("tail").alias("tail_before"), F.col("hi").alias("hi_before"))
    meets = longer.drop("codes").join(known, "g").join(before, "g", "left")
    meets = (meets.withColumn("entry", F.when(F.col("first"), 0).otherwise(F.col("left"))).withColumn("illegal", F.col("illegal") + F.when(F.col("first"), 0).otherwise((~F.concat("tail_before", "head").isin(*PAIRS)).cast("long")))
             .withColumn("turns", F.col("turns") - F.when(~F.col("first") & (F.col("hi_before") == F.col("lo")), 1).otherwise(0)))
    return alone.unionByName(meets.select(*columns)).mapInArrow(_pieces, _PIECE_DDL)


def repaired_rows(rows: DataFrame, **limits: int) -> DataFrame:
    """(conv_id, position, role, text): the rows of every repaired conversation, positions ascending from 0 with gaps between chunks."""
    own = pieces(turns.rows_of(rows, " "), **limits).select("conv_id", "g", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "row"))
    return own.select("conv_id", (F.col("g") * (1 << 24) + F.col("i")).alias("position"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


_SUMMARY = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                      ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SUMMARY_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one row for each conversation; texts pass through the digest only."""
    out = turns.Batcher(_SUMMARY)
    names = ("conv_id", "first", "last", "blank", "duplicate", "truncated", "illegal", "turns", "lo", "hi", "cost", "audit", "roles", "texts")
    for batch in batches:
        for conv, first, last, blank, duplicate, cut, illegal, distinct, lo, hi, cost, audit, roles, texts in zip(*(batch.column(c).to_pylist() for c in names)):
            if first:
                sums, audits, digest, low, high, begun = [0] * 6, [], hashlib.sha256(), None, None, False
            sums = [a + b for a, b in zip(sums, (blank, duplicate, cut, illegal, cost, distinct))]
            audits.append(audit)
            if lo is not None:
                low, high = lo if low is None else low, hi
            if roles:
                body = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts))
                digest.update(f"\n{body}".encode() if begun else body.encode())
                begun = True
            if last:
                gaps = 0 if low is None else high - low + 1 - sums[5]
                out.add((conv, gaps, *sums[:5], "".join(audits), digest.hexdigest()), 200)
                if out.full:
                    yield out.take()
    yield out.take()


def summaries(rows: DataFrame, most_rows: int = turns.CHUNK_ROWS, most_bytes: int = turns.CHUNK_BYTES) -> DataFrame:
    """Faults, cost, edits and digest of the repaired text of each conversation that has rows."""
    return turns.in_order(pieces(turns.rows_of(rows, " "), most_rows, most_bytes), _fold, _SUMMARY_DDL)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32 of ``conv_id:turn`` gives them: of twenty, one is dropped, one emptied, one
    loses its sentence ends, one comes twice, one becomes the user's; nulls read as one space."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = turns.rows_of(conversations, " ").withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def repair_damaged(conversations: DataFrame, most_rows: int = turns.CHUNK_ROWS, most_bytes: int = turns.CHUNK_BYTES) -> DataFrame:
    """Damage and repair; a row for every conversation of the input, also where no row is left."""
    found = summaries(damaged(conversations), most_rows, most_bytes)
    every = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    rest = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *rest, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
