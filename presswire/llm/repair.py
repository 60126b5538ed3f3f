"""Conversation structure repair: cheapest edits, audited, by a persistent dynamic programme."""

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written

SPACE = " \t\n\x0b\x0c\r"
SPAN = 4096    # turn numbers of a segment, and rows solved at once
MODULUS, BASE = 2**61 - 1, 1_000_003
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1

# Roles so far: none, a system turn, last a user turn, last an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}  # what may be put in or made of a turn
NEXT = {state: STEP[state, role[0]] for state, role in WANTED.items()}
ENDS = (START, ASSISTANT)


class Trails:
    """Strings that share their prefixes: every node is one more letter after its parent.

    A node keeps a rolling hash of its string and its ancestors 1, 2, 4, .. letters
    back, so two strings are compared by a search for their longest common prefix.
    Equal hashes are believed only where the nodes are one; otherwise both strings
    are walked, and a collision is settled by the walk.
    """

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.letter, self.depth, self.hash, self.back = [""], [0], [0], [[]]

    def child(self, node: int, letter: str) -> int:
        back, k = [node], 0
        while k < len(self.back[back[k]]):
            back.append(self.back[back[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.modulus)
        self.back.append(back)
        return len(self.letter) - 1

    def upto(self, node: int, depth: int) -> int:
        """The first `depth` letters."""
        extra, k = self.depth[node] - depth, 0
        while extra:
            if extra & 1:
                node = self.back[node][k]
            extra, k = extra >> 1, k + 1
        return node

    def walk(self, a: int, b: int) -> tuple[int, int] | None:
        """The ends of the shortest prefixes of two strings of one length that differ."""
        found = None
        while a != b:
            if self.letter[a] != self.letter[b]:
                found = a, b
            a, b = self.back[a][0], self.back[b][0]
        return found

    def differ(self, a: int, b: int) -> tuple[int, int] | None:
        """As walk, by hashes where these are sure."""
        if self.hash[a] == self.hash[b]:
            return self.walk(a, b)
        x, y = a, b
        for k in reversed(range(len(self.back[x]))):
            if k < len(self.back[x]) and self.hash[self.back[x][k]] != self.hash[self.back[y][k]]:
                x, y = self.back[x][k], self.back[y][k]
        same = self.back[x][0] == self.back[y][0] or self.walk(self.back[x][0], self.back[y][0]) is None
        return (x, y) if same and self.letter[x] != self.letter[y] else self.walk(a, b)

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        found = self.differ(self.upto(a, depth), self.upto(b, depth))
        return self.letter[found[0]] < self.letter[found[1]] if found else self.depth[a] < self.depth[b]

    def text(self, node: int) -> str:
        out = []
        while self.depth[node]:
            out.append(self.letter[node])
            node = self.back[node][0]
        return "".join(reversed(out))


def edits(turns: str, entry: int, modulus: int = MODULUS) -> tuple[tuple[int, str] | None, ...]:
    """For each state after the turns, the cheapest edits (cost, letters) that lead there
    from the entry state, the ASCII-least of equal cost; none if none do.

    A turn is its role's letter (x for other roles), a capital if truncated, or - if it
    has to go. Letters are K, R, D and I; insertions come after turns, not before the first.
    """
    trails = Trails(modulus)
    now = {entry: (0, 0)}

    def offer(to: dict, state: int, cost: int, node: int, letter: str) -> bool:
        if state in to:
            if cost > to[state][0]:
                return False
            if cost == to[state][0]:
                new = trails.child(node, letter)
                if not trails.less(new, to[state][1]):
                    return False
                to[state] = cost, new
                return True
        to[state] = cost, trails.child(node, letter)
        return True

    for turn in turns:
        after: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in now.items():
            offer(after, state, cost + DELETE, node, "D")
            if turn != "-":
                whole = cost + CUT * turn.isupper()
                if (state, turn.lower()) in STEP:
                    offer(after, STEP[state, turn.lower()], whole, node, "K")
                offer(after, NEXT[state], whole + REROLE, node, "R")
        more = True
        while more:  # an insertion costs, so this ends
            more = False
            for state, (cost, node) in list(after.items()):
                more |= offer(after, NEXT[state], cost + INSERT, node, "I")
        now = after
    return tuple((now[s][0], trails.text(now[s][1])) if s in now else None for s in range(4))


@lru_cache(maxsize=20_000)
def _short(turns: str):
    return tuple(edits(turns, entry) for entry in range(4))


def segment(turns: str) -> tuple:
    """The cheapest edits between every two states."""
    return _short(turns) if len(turns) <= 64 else _short.__wrapped__(turns)


class Chain:
    """Segments one after the other. Letters that all cheapest edits begin with are settled."""

    def __init__(self):
        self.settled: list[str] = []
        self.now = {START: (0, ""), USER: (INSERT, "I"), ASSISTANT: (2 * INSERT, "II")}

    def add(self, table) -> None:
        after = {}
        for state, (cost, letters) in self.now.items():
            for to, found in enumerate(table[state]):
                if found:
                    offered = cost + found[0], letters + found[1]
                    after[to] = min(after.get(to, offered), offered)
        same = os.path.commonprefix([letters for _, letters in after.values()])
        self.settled.append(same)
        self.now = {state: (cost, letters[len(same):]) for state, (cost, letters) in after.items()}

    def best(self) -> tuple[int, str]:
        cost, letters = min(self.now[s] for s in ENDS if s in self.now)
        return cost, "".join(self.settled) + letters


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversations (conv_id, turn, role, text) with
    nulls as one space, damaged by crc32 of `conv_id:turn` mod 20: 0 marks a row as gone,
    1 empties its text, 2 takes out its full stops, exclamation and question marks, 3
    repeats it, 4 sets its role to user."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    how = F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled[2].alias("role"), filled[3].alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), "how")
    return rows.withColumn("copy", F.explode(F.expr("if(how = 3, array(1, 2), array(1))"))).drop("copy", "how")


def _prepared(conversations: DataFrame, gone: str | None) -> DataFrame:
    """Every row with what its faults are read from; `digest` names its conversation, role and text."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.col(gone) if gone else F.lit(False)).alias("gone"))
    whole = F.rtrim(F.col("text"), F.lit(SPACE))
    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    parts = [F.length(name).cast("string"), name, F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")]
    return rows.select(
        "*", (whole == "").alias("blank"), (~F.substring(whole, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.floor(F.col("turn") / SPAN).alias("span"), F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256)).alias("digest"))


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


class _Piece:
    """What is known of the rows of a segment so far."""

    def __init__(self, conv, span, number):
        self.key = conv, span, number
        self.turns, self.first_turn, self.last_turn, self.distinct = [], None, None, 0
        self.first, self.last = None, None
        self.faults = [0, 0, 0, 0]

    def add(self, turn, role, blank, duplicate, truncated) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.distinct = turn, self.distinct + 1
        letter = role[:1]
        if self.last is None:
            self.first = letter
        else:
            self.faults[3] += self.last + letter not in ("su", "ua", "au")
        self.last = letter
        kind = 0 if blank else 1 if duplicate else 2 if truncated else None
        if kind is not None:
            self.faults[kind] += 1
        known = letter if letter in ("s", "u", "a") else "x"
        self.turns.append("-" if kind in (0, 1) else known.upper() if kind == 2 else known)

    def row(self) -> tuple:
        table = segment("".join(self.turns)) if self.turns else None
        cells = [c for line in table for c in line] if table else []
        return (*self.key, self.first_turn, self.last_turn, self.distinct, self.first, self.last, self.faults,
                [c[0] if c else None for c in cells], [c[1] if c else None for c in cells])


_PIECE = "conv_id {}, span long, number long, first_turn long, last_turn long, turns long, first string, last string, faults array<long>, costs array<long>, letters array<string>"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _names(schema: str) -> list[str]:
    return [part.split(" ")[0] for part in schema.split(", ")]


def _pieces(schema: str):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind, piece, before, done, held = _names(schema), None, None, None, [], 0

        def close() -> int:
            done.append(piece.row())
            return sum(len(x or "") for x in done[-1][-1])

        def checked(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        for conv, span, turn, role, digest, blank, truncated, gone, later in _runs(checked(batches), ["conv_id", "span", "turn", "role", "digest", "blank", "truncated", "gone", "later"]):
            if piece is None or piece.key[:2] != (conv, span):
                held += close() if piece else 0
                piece, before = _Piece(conv, span, 0), None
            elif len(piece.turns) == SPAN:
                held += close()
                piece = _Piece(conv, span, piece.key[2] + 1)
            if not gone:
                piece.add(turn, role, blank, later or before == (turn, digest), truncated)
                before = turn, digest
            if len(done) >= 1000 or held > 1 << 22:
                yield _batch(done, names, [kind, *_KINDS])
                done.clear()
                held = 0
        if piece:
            close()
            yield _batch(done, names, [kind, *_KINDS])

    return pieces


_AUDIT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(schema: str):
    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, done, conv, chain, state = _names(schema), [], None, None, None

        def close():
            cost, letters = chain.best()
            gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
            done.append((conv, gaps if gaps < 2**63 else None, *state["faults"], cost, letters))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for row in batch.to_pylist():
                if chain is None or row["conv_id"] != conv:
                    if chain:
                        close()
                    conv, chain = row["conv_id"], Chain()
                    state = {"low": None, "high": None, "turns": 0, "faults": [0, 0, 0, 0], "last": None}
                if row["first"] is None:  # only rows that are gone
                    continue
                if row["turns"]:
                    state["low"] = row["first_turn"] if state["low"] is None else state["low"]
                    state["turns"] += row["turns"] - (row["first_turn"] == state["high"])
                    state["high"] = row["last_turn"]
                state["faults"] = [a + b for a, b in zip(state["faults"], row["faults"])]
                if state["last"] is not None:
                    state["faults"][3] += state["last"] + row["first"] not in ("su", "ua", "au")
                state["last"] = row["last"]
                cells = [None if c is None else (c, t) for c, t in zip(row["costs"], row["letters"])]
                chain.add([cells[i:i + 4] for i in range(0, 16, 4)])
            if done:
                yield _batch(done, names, [kind, *[pa.int64()] * 6, pa.string()])
                done.clear()
        if chain:
            close()
            yield _batch(done, names, [kind, *[pa.int64()] * 6, pa.string()])

    return audits


def _spread(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _audited(rows: DataFrame, schema: str) -> DataFrame:
    # texts that come back at a later turn; copies within one turn are neighbours in its order
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = rows.where("not gone and not blank").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(when).alias("since"), F.max(when).alias("until"))
    again = written(again.where("since <> until").drop("until"), "again")
    total = again.agg(F.sum("n")).first()[0] or 0
    narrow = rows.select("conv_id", "span", "turn", "role", "digest", "blank", "truncated", "gone")
    if total:
        narrow = join_counted(narrow, again, "digest", "n", total).withColumn("later", F.coalesce(when > F.col("since"), F.lit(False))).drop("n", "since")
    else:
        narrow = narrow.withColumn("later", F.lit(False))
    pieces = _PIECE.format(schema)
    solved = narrow.repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "turn", "role", "digest").mapInArrow(_pieces(pieces), pieces)
    return written(_spread(solved, "span", "number").mapInArrow(_audits(_AUDIT.format(schema)), _AUDIT.format(schema)), "audits")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, audit row, letter, role, text) of each edit in order, texts as bytes; the
    audit row alone where a conversation begins. Rows come after their audit."""
    columns = ["conv_id", "report", "role", "text"]
    conv, report, letters, at, state = None, None, "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            role = WANTED[state]
            at, state = at + 1, NEXT[state]
            yield conv, report, "I", role, b""

    for name, begins, role, text in _runs(batches, columns):
        if begins:
            yield from inserted()
            conv, report, letters, at, state = name, begins, begins["audit"], 0, START
            yield conv, report, None, None, None
            continue
        yield from inserted()
        letter = letters[at]
        at += 1
        if letter == "R":
            role, state = WANTED[state], NEXT[state]
        elif letter == "K":
            state = STEP[state, role[:1]]
        yield conv, report, letter, role, text
    yield from inserted()


def _merged(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits and their rows, a conversation's in one task, sorted, held one batch at a time."""
    report = F.struct(*[F.col(c) for c in audits.columns if c != "conv_id"]).alias("report")
    heads = audits.select("conv_id", report)
    body = rows.where("not gone").select("conv_id", "turn", "role", "digest", F.col("text").cast("binary").alias("text"))
    return _spread(heads.unionByName(body, allowMissingColumns=True).withColumn("body", F.col("report").isNull()), "body", "turn", "role", "digest").select("conv_id", "report", "role", "text")


def report(conversations: DataFrame, gone: str | None = None) -> DataFrame:
    """What is wrong with each conversation, the cheapest edits that mend it, and a digest of the result.

    Rows (conv_id, turn, role, text) are taken by turn, nulls first, then role, then
    SHA-256 of conversation, role and text. Faults and edits are as in `edits`; roles have
    to read `(s?(ua)+)?`. Rows are solved in segments of 4,096 turn numbers, in tasks of
    their own: a segment's answer is the cheapest edits between every two states, so a
    conversation of any length is a chain of such answers and no task holds its rows.
    Its digest is a SHA-256 over one text and so is taken by one task, row by row.

    Returns one row per conv_id, a null one included: (conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256). Null roles and texts count as
    one space, an empty role as a letter that fits nowhere; copies are duplicates but the
    first. `gone` names a boolean column of rows that only name their conversation. gaps
    beyond a long are null. Other columns are ignored.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = _prepared(conversations, gone)
    audits = _audited(rows, kind)
    out = f"{_AUDIT}, repaired_sha256 string".format(kind)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, found, types, sha, now, some = _names(out), [], None, None, None, False

        def checked(batches):
            nonlocal types
            for batch in batches:
                types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield batch

        for conv, report, letter, role, text in _turns(checked(batches)):
            if letter is None:
                if now:
                    found.append((*now, sha.hexdigest()))
                now, sha, some = (conv, *report.values()), hashlib.sha256(), False
                if len(found) == 1000:
                    yield _batch(found, names, types)
                    found.clear()
            elif letter != "D":
                sha.update(b"\n" * some + role.encode() + b":")
                sha.update(text)
                some = True
        if now:
            found.append((*now, sha.hexdigest()))
            yield _batch(found, names, types)

    return _merged(rows, audits).mapInArrow(digests, out)


def repaired(conversations: DataFrame, gone: str | None = None) -> DataFrame:
    """The mended conversations as report digests them: (conv_id, position, edit, role,
    text), positions from 0, edit K, R or I. Deleted rows have no row here."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = _prepared(conversations, gone)
    out = f"conv_id {kind}, position long, edit string, role string, text string"

    def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, types, position, held = [], None, 0, 0

        def checked(batches):
            nonlocal types
            for batch in batches:
                types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield batch

        for conv, _, letter, role, text in _turns(checked(batches)):
            if letter is None:
                position = 0
            elif letter != "D":
                found.append((conv, position, letter, role, text.decode(errors="replace")))
                position, held = position + 1, held + len(text)
            if len(found) == 1000 or held > 1 << 24:
                yield _batch(found, _names(out), types)
                found.clear()
                held = 0
        if found:
            yield _batch(found, _names(out), types)

    return _merged(rows, _audited(rows, kind)).mapInArrow(mended, out)
