"""Repair of conversations: the cheapest edits that make the roles of a conversation lawful.

A lawful conversation is empty, or an optional system turn followed by one or more
pairs of a user's and an assistant's turn.  Turns are kept, given another role,
deleted, or inserted.  The edits come from a cost vector over the four states of
that language: what it costs to finish from each state, computed from the last turn
to the first.  Vectors are normalised (least entry 0), of which only few exist, so
by the method of the Four Russians the step over every block of BLOCK symbols is
computed once for every vector; a conversation is then a look-up per block.

The trace runs forward: a block is expanded backward from the vector known at its
end, and at each turn the first letter in ASCII order that still leads to the least
cost is taken.  So among equally cheap edits the audit text is the least.

A conversation of more than PIECE_TURNS turns is cut into pieces that different
tasks handle: each gives the vector at its start for every vector at its end, then
the state at its end for every state at its start; two small tables chain them.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut
from weftline.operators.windows import hot_keys, ordered_window, same_keys

#: Costs of the edits; a turn that is cut short and stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.  What a role leads to from a state (s, u, a).
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that is inserted, or given, in each state.
WANTED = ("u", "u", "a", "u")
ROLE_NAMES = {"u": "user", "a": "assistant"}
#: What it costs to finish in each state once no turn is left.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: Symbols: role class (s, u, a, other) doubled, plus 1 if cut short; GONE has to be deleted.
CLASSES = "sua"
GONE = 8
SYMBOLS = 9
BLOCK = 3
#: Conversations of more turns are handled in pieces of half so many.
PIECE_TURNS = 200_000
WHITE = " \t\n\r\x0b\x0c"


def consumed(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits that use up a turn, letters in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        role, more = (*CLASSES, "?")[symbol >> 1], TRUNCATED * (symbol & 1)
        if role in LEADS[state]:
            out.append(("K", more, LEADS[state][role]))
        out.append(("R", REROLE + more, LEADS[state][WANTED[state]]))
    return out


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to finish from before a turn, given those from after it."""
    here = [min(cost + after[to] for _, cost, to in consumed(symbol, s)) for s in range(4)]
    # Insertions first: two in a row lead from a user's or assistant's turn back to itself, so one is enough there.
    pair = [min(here[2], INSERT + here[3]), min(here[3], INSERT + here[2])]
    return (min(here[0], INSERT + pair[0]), min(here[1], INSERT + pair[0]), *pair)


class BlockTables:
    """The normalised vectors, and for every block of up to BLOCK symbols the step from each vector."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.index: dict[tuple[int, ...], int] = {}
        self.end = self._known(AT_END)[0]
        single: list[list[tuple[int, int]]] = []
        while len(single) < len(self.vectors):
            vector = self.vectors[len(single)]
            single.append([self._known(before(s, vector)) for s in range(SYMBOLS)])
        #: steps[n][code][vector] = (vector at the block's start, cost added); code has the first symbol as highest digit.
        self.steps: list[list[list[tuple[int, int]]]] = [[[(v, 0) for v in range(len(self.vectors))]]]
        for _ in range(BLOCK):
            shorter = self.steps[-1]
            longer = []
            for s in range(SYMBOLS):
                for by_vector in shorter:
                    longer.append([(single[v][s][0], cost + single[v][s][1]) for v, cost in by_vector])
            self.steps.append(longer)

    def _known(self, vector: tuple[int, ...]) -> tuple[int, int]:
        least = min(vector)
        plain = tuple(c - least for c in vector)
        if plain not in self.index:
            self.index[plain] = len(self.vectors)
            self.vectors.append(plain)
        return self.index[plain], least

    def blocks(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(length, code) of the blocks."""
        out = []
        for i in range(0, len(symbols), BLOCK):
            part = symbols[i:i + BLOCK]
            out.append((len(part), reduce(lambda code, s: code * SYMBOLS + s, part, 0)))
        return out

    def backward(self, symbols: list[int], end: int) -> tuple[list[int], int]:
        """Vector numbers at all block bounds, first to last, and the cost that the blocks add to the last vector's."""
        bounds, total = [end], 0
        steps = self.steps
        for n, code in reversed(self.blocks(symbols)):
            vector, cost = steps[n][code][bounds[-1]]
            bounds.append(vector)
            total += cost
        bounds.reverse()
        return bounds, total

    def forward(self, symbols: list[int], bounds: list[int], state: int) -> tuple[list[str], int]:
        """The least audit letters of each turn (insertions before it, then its own), and the state after the last."""
        out = []
        for k, last in enumerate(bounds[1:]):
            part = symbols[k * BLOCK:(k + 1) * BLOCK]
            costs = [self.vectors[last]]
            for s in reversed(part):
                costs.append(before(s, costs[-1]))
            for i, s in enumerate(part):
                here, after = costs[len(part) - i], costs[len(part) - i - 1]
                letters = ""
                while True:
                    options = consumed(s, state)
                    found = next((o for o in options[:1] if o[1] + after[o[2]] == here[state]), None)
                    if found is None and INSERT + here[LEADS[state][WANTED[state]]] == here[state]:
                        letters += "I"
                        state = LEADS[state][WANTED[state]]
                        continue
                    letter, _, state = found or next(o for o in options[1:] if o[1] + after[o[2]] == here[state])
                    out.append(letters + letter)
                    break
        return out, state

    def closing(self, state: int) -> str:
        """Insertions after the last turn."""
        letters = ""
        while AT_END[state]:
            letters += "I"
            state = LEADS[state][WANTED[state]]
        return letters


@cache
def tables() -> BlockTables:
    return BlockTables()


def is_blank(text: str) -> bool:
    return not text.strip(WHITE)


def symbol_of(role: str, text: str, gone: bool) -> int:
    if gone:
        return GONE
    found = CLASSES.find(role[:1]) if role else -1
    return 2 * (found if found >= 0 else 3) + (text.rstrip(WHITE)[-1:] not in (".", "!", "?"))


def apply_edits(audit: list[str], turns: list[tuple[str, str]], state: int) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) that the letters of each turn make of the turns, and the state after them."""
    out = []
    for letters, (role, text) in zip(audit, turns):
        for letter in letters:
            if letter == "D":
                continue
            to = role[:1] if letter == "K" else WANTED[state]
            out.append((role if letter == "K" else ROLE_NAMES[to], "" if letter == "I" else text))
            state = LEADS[state][to]
    return out, state


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "piece bigint, pieces bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired array<struct<role: string, text: string>>"
_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def repaired(turns: list[tuple]) -> tuple:
    """All of RESULT for one whole conversation, given (turn, role, text) in order."""
    seen, symbols, faults = set(), [], [0, 0, 0]
    for _, role, text in turns:
        blank = is_blank(text)
        again = (role, text) in seen
        seen.add((role, text))
        symbol = symbol_of(role, text, blank or again)
        symbols.append(symbol)
        if blank:
            faults[0] += 1
        elif again:
            faults[1] += 1
        else:
            faults[2] += symbol & 1
    t = tables()
    bounds, cost = t.backward(symbols, t.end)
    audit, state = t.forward(symbols, bounds, 0)
    plain = [(role, text) for _, role, text in turns]
    edited, state = apply_edits(audit, plain, 0)
    closing = t.closing(state)
    edited += apply_edits([closing], [("", "")], state)[0]
    numbers = {n for n, _, _ in turns if n is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (0, 1, gaps, *faults, illegal, cost + t.vectors[bounds[0]][0], "".join(audit) + closing, [{"role": r, "text": x} for r, x in edited])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the conversations of a sorted partition; a conversation may go on in the next batch."""
    ids: list = []
    rows: list[tuple] = []
    open_id, turns, started, kind = None, [], False, None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64()] * (2 + len(COUNTS)) + [pa.string(), _REPAIRED]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["conv", "piece", "pieces", *COUNTS, "audit", "repaired"])
        ids.clear()
        rows.clear()
        return batch

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or conv != open_id:
                if started:
                    ids.append(open_id)
                    rows.append(repaired(turns))
                open_id, turns, started = conv, [], True
            if role is not None or text is not None:
                turns.append((turn, " " if role is None else role, " " if text is None else text))
        if rows:
            yield flush()
    if started:
        ids.append(open_id)
        rows.append(repaired(turns))
        yield flush()


def repair_conversations(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_turns: int = PIECE_TURNS
) -> DataFrame:
    """Rows (conv_col, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    One row for each conversation, with piece 0 of 1; one with more than `piece_turns`
    turns has a row for each piece of its turns, in order, whose counts, costs, audit
    texts and repaired turns add up.  Turns stand in the order of `turn_col`, nulls
    first, ties by role and text.  The role class is the role's first letter.  A turn's first fault
    counts: blank (nothing but ASCII white space), duplicate (role and text were seen
    earlier), truncated (the last other character is none of . ! ?).  `audit` holds
    a letter for each edit: K keep, R other role, D delete, I insert; `repaired` is an
    array of structs (role, text).

    A null role or text counts as one space; a row where both are null is no turn and
    only names its conversation, whose result may be empty.  A null conversation id
    is one conversation.  Other columns are ignored.  An empty table gives an empty result.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["conv"].dataType.simpleString()
    hot = hot_keys(rows, ["conv"], piece_turns)
    rest = rows
    if hot is not None:
        rest = rows.join(F.broadcast(hot.drop("rows")), same_keys(["conv"]), "left_anti")
    ordered = rest.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    out = ordered.mapInArrow(_whole, f"conv {kind}, {RESULT}")
    if hot is not None:
        long = rows.join(F.broadcast(hot.drop("rows")), same_keys(["conv"]), "left_semi")
        out = out.unionByName(_in_pieces(long, kind, max(1, piece_turns // 2), piece_turns))
    return out.withColumnRenamed("conv", conv_col)


def _in_pieces(rows: DataFrame, kind: str, size: int, hot_rows: int) -> DataFrame:
    """Results of long conversations by piece."""
    named = rows.where("role is not null or text is not null").fillna(" ", ["role", "text"])
    # Copies of a turn follow each other and all but the first go: they are counted, not carried.
    apart = named.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("filled"), F.col("turn").alias("turn"))
    first = apart.groupBy("conv", "role", "text").agg(F.min(place).alias("first")).select(
        F.col("conv").alias("of_conv"), F.col("role").alias("of_role"), F.col("text").alias("of_text"), "first")
    same = F.col("conv").eqNullSafe(F.col("of_conv")) & (F.col("role") == F.col("of_role")) & (F.col("text") == F.col("of_text"))
    flagged = apart.join(first, same).select("conv", "turn", "role", "text", "copies", (place > F.col("first")).alias("again"))
    numbered = ordered_window(flagged, ["conv"], ["turn", "role", "text"], {"pos": _row_number()}, hot_rows)
    placed = numbered.withColumn("piece", F.floor((F.col("pos") - 1) / size))
    # The shuffle to pieces happens once; the three passes read the written table in its order.
    held = cut(placed.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "pos"))
    passes = held.select("conv", "piece", "turn", "role", "text", "copies", "again")

    vectors = passes.mapInArrow(_piece_vectors, f"conv {kind}, piece bigint, starts array<int>, costs array<bigint>, head struct<turn: bigint, role: string>, tail struct<turn: bigint, role: string>")
    chained = cut(vectors.repartition("conv").sortWithinPartitions("conv", F.desc("piece")).mapInArrow(
        _chain_vectors, f"conv {kind}, piece bigint, at_end int, head struct<turn: bigint, role: string>, tail struct<turn: bigint, role: string>"))
    states = _told(passes, chained.select("conv", "piece", "at_end")).mapInArrow(_piece_states, f"conv {kind}, piece bigint, ends array<int>")
    begun = cut(states.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_chain_states, f"conv {kind}, piece bigint, state int"))
    by_conv = Window.partitionBy("conv").orderBy("piece")
    around = chained.withColumn("pieces", F.count("*").over(Window.partitionBy("conv"))).withColumn("previous", F.lag("tail").over(by_conv))
    known = around.join(begun.select(F.col("conv").alias("c"), F.col("piece").alias("p"), "state"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")))
    return _told(passes, known.select("conv", "piece", "at_end", "state", "pieces", "previous")).mapInArrow(_piece_results, f"conv {kind}, {RESULT}")


def _row_number():
    from weftline.operators.windows import Win

    return Win("row_number")


def _told(rows: DataFrame, by_piece: DataFrame) -> DataFrame:
    """The turns, each with what is known of its piece: one small row for every half PIECE_TURNS turns, so it is broadcast."""
    small = by_piece.withColumnsRenamed({"conv": "its_conv", "piece": "its_piece"})
    same = F.col("conv").eqNullSafe(F.col("its_conv")) & (F.col("piece") == F.col("its_piece"))
    return rows.join(F.broadcast(small), same).drop("its_conv", "its_piece")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """((conv, piece), turns) of a sorted partition."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["conv"], row["piece"])
            if rows and here != key:
                yield key, rows
                rows = []
            key = here
            rows.append(row)
    if rows:
        yield key, rows


def _sent(rows: Iterator[dict], types: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", kind), *types.items()])
    for row in rows:
        yield pa.RecordBatch.from_pylist([row], schema)


def _conv_type(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType | None, Iterator[pa.RecordBatch]]:
    first = next(batches, None)
    if first is None:
        return None, iter(())

    def again():
        yield first
        yield from batches

    return first.schema.field(0).type, again()


_END = pa.struct([("turn", pa.int64()), ("role", pa.string())])


def _symbols(rows: list[dict]) -> list[int]:
    return [symbol_of(r["role"], r["text"], r["again"] or is_blank(r["text"])) for r in rows]


def _piece_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every vector at a piece's end: the vector at its start and the cost."""
    kind, batches = _conv_type(batches)

    def rows():
        t = tables()
        for (conv, piece), turns in _pieces(batches):
            current = [(v, 0) for v in range(len(t.vectors))]
            for n, code in reversed(t.blocks(_symbols(turns))):
                step = t.steps[n][code]
                current = [(step[v][0], cost + step[v][1]) for v, cost in current]
            ends = [{"turn": r["turn"], "role": r["role"]} for r in (turns[0], turns[-1])]
            yield {"conv": conv, "piece": piece, "starts": [v for v, _ in current], "costs": [c for _, c in current], "head": ends[0], "tail": ends[1]}

    return _sent(rows(), {"piece": pa.int64(), "starts": pa.list_(pa.int32()), "costs": pa.list_(pa.int64()), "head": _END, "tail": _END}, kind)


def _chain_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector at each piece's end, from the last piece to the first."""
    kind, batches = _conv_type(batches)

    def rows():
        t, conv, vector = tables(), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if vector is None or row["conv"] != conv:
                    conv, vector = row["conv"], t.end
                yield {"conv": conv, "piece": row["piece"], "at_end": vector, "head": row["head"], "tail": row["tail"]}
                vector = row["starts"][vector]

    return _sent(rows(), {"piece": pa.int64(), "at_end": pa.int32(), "head": _END, "tail": _END}, kind)


def _piece_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every state at a piece's start: the state at its end."""
    kind, batches = _conv_type(batches)

    def rows():
        t = tables()
        for (conv, piece), turns in _pieces(batches):
            symbols = _symbols(turns)
            bounds, _ = t.backward(symbols, turns[0]["at_end"])
            yield {"conv": conv, "piece": piece, "ends": [t.forward(symbols, bounds, s)[1] for s in range(4)]}

    return _sent(rows(), {"piece": pa.int64(), "ends": pa.list_(pa.int32())}, kind)


def _chain_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at each piece's start, from the first piece to the last."""
    kind, batches = _conv_type(batches)

    def rows():
        conv, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv"] != conv:
                    conv, state = row["conv"], 0
                yield {"conv": conv, "piece": row["piece"], "state": state}
                state = row["ends"][state]

    return _sent(rows(), {"piece": pa.int64(), "state": pa.int32()}, kind)


def _piece_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of each piece in the conversation's result."""
    kind, batches = _conv_type(batches)

    def rows():
        t = tables()
        for (conv, piece), turns in _pieces(batches):
            symbols = _symbols(turns)
            head = turns[0]
            bounds, _ = t.backward(symbols, head["at_end"])
            audit, last = t.forward(symbols, bounds, head["state"])
            plain = [(r["role"], r["text"]) for r in turns]
            edited, _ = apply_edits(audit, plain, head["state"])
            before_it = head["previous"]
            chain = ([before_it] if before_it else []) + turns
            surplus = [r["copies"] - 1 for r in turns]
            letters = "".join(a + "D" * n for a, n in zip(audit, surplus))
            if piece == head["pieces"] - 1:
                closing = t.closing(last)
                letters += closing
                edited += apply_edits([closing], [("", "")], last)[0]
            blank = [is_blank(r["text"]) for r in turns]
            faults = [sum(r["copies"] for r, b in zip(turns, blank) if b), sum(r["copies"] - (not r["again"]) for r, b in zip(turns, blank) if not b),
                      sum(s & 1 for s in symbols if s != GONE)]
            # Steps of more than one between neighbouring turn numbers are the gaps.
            numbers = [r["turn"] for r in chain if r["turn"] is not None]
            gaps = sum(b - a - 1 for a, b in zip(numbers, numbers[1:]) if b > a)
            illegal = sum(surplus) + sum(a["role"][:1] + b["role"][:1] not in ("su", "ua", "au") for a, b in zip(chain, chain[1:]))
            cost = DELETE * letters.count("D") + REROLE * letters.count("R") + INSERT * letters.count("I")
            cost += TRUNCATED * sum(s & 1 for s, a in zip(symbols, audit) if not a.endswith("D"))
            yield {"conv": conv, "piece": piece, "pieces": head["pieces"], **dict(zip(COUNTS, (gaps, *faults, illegal, cost))), "audit": letters,
                   "repaired": [{"role": r, "text": x} for r, x in edited]}

    types = {"piece": pa.int64(), "pieces": pa.int64(), **dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string(), "repaired": _REPAIRED}
    return _sent(rows(), types, kind)


def fold_pieces(results: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows (conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for each conversation.

    The digest is that of the repaired turns as role:text, joined by line feeds.  The pieces
    of a long conversation are streamed through it one by one; its audit text must fit in a row.
    """
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    single = results.where("pieces = 1").select(conv_col, *COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    parts = results.where("pieces > 1").select(F.col(conv_col).alias("conv"), "piece", *COUNTS, "audit", lines.alias("lines"), F.size("repaired").alias("n"))
    kind = parts.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"
    folded = parts.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_fold, schema)
    return single.unionByName(folded.withColumnRenamed("conv", conv_col))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, batches = _conv_type(batches)

    def rows():
        conv, sums, audit, digest, empty = None, None, [], None, True

        def result():
            return {"conv": conv, **dict(zip(COUNTS, sums)), "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

        for batch in batches:
            for row in batch.to_pylist():
                if digest is None or row["conv"] != conv:
                    if digest is not None:
                        yield result()
                    conv, sums, audit, digest, empty = row["conv"], [0] * len(COUNTS), [], hashlib.sha256(), True
                sums = [a + row[c] for a, c in zip(sums, COUNTS)]
                audit.append(row["audit"])
                if row["n"]:
                    digest.update(("" if empty else "\n").encode() + row["lines"].encode())
                    empty = False
        if digest is not None:
            yield result()

    return _sent(rows(), {**dict.fromkeys(COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()}, kind)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with a fixed share of turns damaged, as the registered query states.

    A dropped turn leaves a row without role and text, which names its conversation.
    """
    def key(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    k = F.pmod(F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace(key("text"), "[.!?]", "")).otherwise(key("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(key("role"))
    there = F.col("k") != 0
    copies = F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return conversations.withColumn("k", k).select("conv_id", "turn", F.when(there, role).alias("role"), F.when(there, text).alias("text"), F.explode(copies).alias("copy")).drop("copy")
