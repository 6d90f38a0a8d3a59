"""Conversation repair: rows streamed in turn order, a small DP carried from batch to batch.

Rows are dealt by conversation and sorted by turn inside partitions, so a task sees each conversation as one
run of rows over any number of Arrow batches. What it carries is bounded: for each of four states of the
role pattern ``(s?(ua)+)?`` the cheapest cost so far, the order of the states' audits and a running hash of
the repaired text. Four bytes a row tell how each state was reached; of a giant conversation they go to
the shared folder in chunks of ``CHUNK_ROWS`` rows and are read back, last chunk first, for the audit.

Edits of a row are Keep (0), Rerole (3) and Delete (4, the only one for blank and repeated rows); Insert (3)
adds an empty user or assistant row anywhere; a truncated row that stays adds 3. All audits that have
used up the same rows end in a row's edit, so none begins another one and equal costs are told apart by
the order of what came before, which four ranks keep without the texts.

Whether a row repeats an earlier one is found before the stream: the first turn of each (conversation,
role, text) is an aggregate joined back, so no set of a conversation's texts is held.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from barriometrics.session import scratch_path

#: Costs of the edits.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
#: Rows whose backpointers are held in memory, four bytes each.
CHUNK_ROWS = 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
#: What comes next after each state, and the name of its role.
_FOLLOWS = (USER, USER, ASSISTANT, USER)
_NAMES = ("", "system", "user", "assistant")
_LETTERS = "DKR"
_BLANKS = " \t\n\x0b\x0c\r"


class Backpointers:
    """How each state was reached by each row: four bytes a row, whole chunks in files."""

    def __init__(self, folder: str, chunk_rows: int):
        self.folder, self.chunk = folder, 4 * chunk_rows
        self.held, self.files = bytearray(), []

    def add(self, codes: bytes) -> None:
        self.held += codes
        if len(self.held) >= self.chunk:
            name = f"{self.folder}/{uuid.uuid4().hex}.back"
            system, place = fs.FileSystem.from_uri(name)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(place) as out:
                out.write(bytes(self.held))
            self.files.append(name)
            self.held = bytearray()

    def walk(self, state: int) -> str:
        """The edits of the best way to a state, from the first row on."""
        parts: list[str] = []
        while True:
            letters = []
            for at in range(len(self.held) - 4, -1, -4):
                code = self.held[at + state]
                letters.append(_LETTERS[code >> 4] + "I" * (code >> 2 & 3))
                state = code & 3
            parts.append("".join(letters))
            if not self.files:
                return "".join(parts)[::-1]
            name = self.files.pop()
            system, place = fs.FileSystem.from_uri(name)
            with system.open_input_stream(place) as source:
                self.held = bytearray(source.read())
            system.delete_file(place)


class Repair:
    """The state of one conversation."""

    def __init__(self, folder: str, chunk_rows: int = CHUNK_ROWS):
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}  # cost, rank of the audit among the states'
        self.hashes = {START: hashlib.sha256()}
        self.back = Backpointers(folder, chunk_rows)

    def row(self, role: str, text: str, gone: bool, truncated: bool) -> None:
        """``gone``: a blank or repeated row, which must be deleted."""
        extra = TRUNCATED if truncated else 0
        found: dict[int, tuple[int, int, str, int, int, int]] = {}
        for before, (cost, rank) in self.best.items():
            state = before
            for inserted in range(3):
                ways = [(state, 0, DELETE)]
                if not gone:
                    follows = _FOLLOWS[state]
                    ways.append((follows, 2, REROLE + extra))
                    if role[:1] == _NAMES[follows][0]:
                        ways.append((follows, 1, KEEP + extra))
                    elif role[:1] == "s" and state == START:
                        ways.append((SYSTEM, 1, KEEP + extra))
                for to, letter, price in ways:
                    way = (cost + inserted * INSERT + price, rank, "I" * inserted + _LETTERS[letter], before, inserted, letter)
                    if to not in found or way < found[to]:
                        found[to] = way
                state = _FOLLOWS[state]
        order = sorted(found, key=lambda s: found[s][1:3])
        codes, hashes = bytearray(4), {}
        for state, (_, _, _, before, inserted, letter) in found.items():
            codes[state] = before | inserted << 2 | letter << 4
            hashes[state] = self._with(before, inserted, _NAMES[state] if letter == 2 else role if letter else None, text)
        self.best = {s: (found[s][0], order.index(s)) for s in found}
        self.hashes = hashes
        self.back.add(codes)

    def _with(self, state: int, inserted: int, role: str | None, text: str):
        new = self.hashes[state].copy()
        for _ in range(inserted):
            line = f"{_NAMES[_FOLLOWS[state]]}:"
            new.update((line if state == START else "\n" + line).encode())
            state = _FOLLOWS[state]
        if role is not None:
            new.update(("" if state == START else "\n").encode() + f"{role}:{text}".encode())
        return new

    def finish(self) -> tuple[int, str, str]:
        """Cost, audit, and the hash of the repaired conversation."""
        ends = []
        for before, (cost, rank) in self.best.items():
            state = before
            for inserted in range(3):
                if state in (START, ASSISTANT):
                    ends.append((cost + inserted * INSERT, rank, before, inserted))
                state = _FOLLOWS[state]
        cost, _, before, inserted = min(ends)
        return cost, self.back.walk(before) + "I" * inserted, self._with(before, inserted, None, "").hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) spoilt by crc32 of ``conv_id:turn`` modulo 20; NULLs there become one space.

    0: ``dropped`` is set; 1: no text; 2: no ``.!?``; 3: the row comes twice; 4: role user. Others stay as they are.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    spoilt = rows.withColumn("kind", kind).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(F.col("kind") == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return spoilt.drop("_copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``later`` (an equal role and text has an earlier turn), dealt by conversation, sorted by turn, NULL first.

    Rows of one turn are ordered by role and text, so equal rows are neighbours.
    """
    known = [F.xxhash64("role", "text").alias("d1"), F.xxhash64("text", "role", F.lit(1)).alias("d2")]
    keyed = rows.select("*", F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), *known)
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"))
    by = ["conv", "no_conv", "d1", "d2"]
    firsts = keyed.where("not dropped").groupBy(*by).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    flagged = keyed.join(firsts, by, "left").withColumn("later", F.coalesce(place > F.col("first"), F.lit(False)))
    flagged = flagged.select("conv", "no_conv", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", "dropped", "later")
    order = [F.col("no_conv"), F.col("conv"), F.col("no_turn").desc(), F.col("turn"), F.col("role"), F.col("text")]
    return flagged.repartition("conv", "no_conv").sortWithinPartitions(*order)


class _Conversation:
    """Counts and repair of one conversation as its rows come."""

    def __init__(self, key: tuple[bool, int], folder: str, chunk_rows: int):
        self.key, self.repair = key, Repair(folder, chunk_rows)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def row(self, turn: int | None, role: str, text: str, later: bool) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        same = self.last == (turn, role, text)
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in ("su", "ua", "au")
        self.last = (turn, role, text)
        bare = text.strip(_BLANKS)
        blank = not bare
        duplicate = not blank and (later or same)
        truncated = not blank and not duplicate and bare[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.repair.row(role, text, blank or duplicate, truncated)

    def done(self) -> tuple:
        cost, audit, digest = self.repair.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key[1], self.key[0], gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest)


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_OUT = ["conv", "no_conv", *_NUMBERS, "audit", "repaired_sha256"]


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows``: conv_id, turn, role, text and optionally ``dropped`` (the row only says that its conversation exists).
    NULL role or text is one space. A NULL conv_id is a conversation of its own; NULL turns come first and
    are ignored by gaps. Rows of one turn are taken in order of role and text. Other columns are ignored.
    An empty table gives no rows; texts of any length and conversations of any number of rows are whole.
    """
    folder = scratch_path(rows.sparkSession, "backpointers")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False).alias("dropped")
    rows = in_order(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role"), blank("text"), dropped))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("no_conv", "conv", "turn", "no_turn", "role", "text", "dropped", "later"))
            for no_conv, conv, turn, no_turn, role, text, dropped, later in zip(*columns, strict=True):
                if held is None or held.key != (no_conv, conv):
                    if held is not None:
                        out.append(held.done())
                    held = _Conversation((no_conv, conv), folder, chunk_rows)
                if not dropped:
                    held.row(None if no_turn else turn, role, text, later)
            if out:
                yield pd.DataFrame(out, columns=_OUT)
        if held is not None:
            yield pd.DataFrame([held.done()], columns=_OUT)

    schema = "conv long, no_conv boolean, " + ", ".join(f"{n} long" for n in _NUMBERS) + ", audit string, repaired_sha256 string"
    found = rows.mapInPandas(stream, schema)
    return found.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), *_NUMBERS, "audit", "repaired_sha256")


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), turn (NULL if inserted), role, text.

    ``audits`` has conv_id and audit, as from ``repair`` over the same rows; deleted rows are left out.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    dropped = ~F.col("dropped") if "dropped" in rows.columns else F.lit(True)
    body = rows.where(dropped).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role"), blank("text"), F.lit(1).alias("kind"))
    head = audits.select(F.col("conv_id").cast("long"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = head.unionByName(body).select(
        F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"),
        F.col("turn").isNull().alias("no_turn"), "role", "text", "kind",
    )
    order = [F.col("no_conv"), F.col("conv"), F.col("kind"), F.col("no_turn").desc(), F.col("turn"), F.col("role"), F.col("text")]
    both = both.repartition("conv", "no_conv").sortWithinPartitions(*order)
    names = ["conv", "no_conv", "place", "edit", "turn", "no_turn", "role", "text"]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, audit, at, state, place = (False, 0), "", 0, START, 0
        for batch in batches:
            out = []

            def put(edit: str, role: str | None, turn: int, no_turn: bool, text: str) -> None:
                nonlocal state, place
                if edit == "K" and role is not None and role[:1] == "s":
                    state = SYSTEM
                else:
                    state = _FOLLOWS[state]
                out.append((key[1], key[0], place, edit, turn, no_turn, role if edit == "K" else _NAMES[state], text))
                place += 1

            columns = (batch[c].tolist() for c in ("no_conv", "conv", "turn", "no_turn", "role", "text", "kind"))
            for no_conv, conv, turn, no_turn, role, text, kind in zip(*columns, strict=True):
                if not kind:
                    key, audit, at, state, place = (no_conv, conv), text, 0, START, 0
                elif audit[at] != "I":
                    if audit[at] != "D":
                        put(audit[at], role, turn, no_turn, text)
                    at += 1
                while audit[at : at + 1] == "I":  # those before the next row
                    put("I", None, 0, True, "")
                    at += 1
            if out:
                yield pd.DataFrame(out, columns=names)

    schema = "conv long, no_conv boolean, place long, edit string, turn long, no_turn boolean, role string, text string"
    found = both.mapInPandas(stream, schema)
    return found.select(F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"), "place", "edit", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "text")


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation's damage and repair."""
    return repair(damage(conversations))
