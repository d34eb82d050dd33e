"""Conversation structure repair: the cheapest edits that give every conversation the order of its roles.

Rows are dealt by conversation and sorted by turn; tasks stream them, and what a conversation needs is carried
from one Arrow batch to the next. The edits are a shortest path through four states (what the repaired
conversation ends in: nothing, a system, a user or an assistant row); after each row a state holds its least cost, its place among
the other states' edits in ASCII order, the running SHA-256 of its repaired text, and its way back. So one pass gives
the edits, their cost and the digest, and no text is kept. Ways back take four bytes a row; beyond ``SPILL`` rows
they go to the cluster's shared folder and are read backwards at the end of the conversation.

Which rows repeat an earlier row of their conversation is found by a window within the same partitions (one more
sort, no shuffle, no table of rows seen). The SHA-256 of a conversation is one chain over its text, so its rows
do pass through one task, in bounded memory; a conversation's audit is as long as its rows.

Order: by turn (NULL first), then role, then text. Defined results: NULL roles and texts are one space; a NULL conv_id
is a conversation of its own, a NULL turn or conv_id is one space in the damage key; rows that repeat in the table are
rows (and duplicates); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mktpulse.llm.common import open_fs, prepare, shared_folder

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a conversation whose ways back stay in memory.
SPILL = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

#: States: what the repaired rows end in so far. From each, the role that may follow and the state it leads to;
#: a system row may come first only.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
NEXT = {START: ("user", AFTER_USER), AFTER_SYSTEM: ("user", AFTER_USER), AFTER_USER: ("assistant", AFTER_ASSISTANT),
        AFTER_ASSISTANT: ("user", AFTER_USER)}
COMPLETE = (START, AFTER_ASSISTANT)
LETTERS = "DIKR"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the table with faults, each by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays here with ``gone``, so that its conversation is known), 1 empties the text, 2 takes the
    marks ``.!?`` out, 3 repeats the row, 4 makes the role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault"))
    text = (F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("fault") == 0).alias("gone"),
                       F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, fault ('b'lank, 'd'uplicate, 't'runcated or ''), dealt by conversation, in order."""
    dealt = rows.repartition("conv_id")
    # (role, text) by two hashes of it: what is compared is 128 bits
    same = [F.xxhash64("role", "text"), F.xxhash64(F.lit("again"), "text", "role")]
    first = Window.partitionBy("conv_id", "gone", *same).orderBy(F.asc_nulls_first("turn"))
    meets = dealt.withColumn("_nth", F.row_number().over(first))
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(F.col("gone"), "").when(body == "", "b").when(F.col("_nth") > 1, "d")
             .when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "t").otherwise(""))
    return (meets.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"), "_nth")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "_nth"))


class _WaysBack:
    """Per row and state one byte: the state before, the rows inserted, the letter. Written on in the shared folder when long."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.rows, self.parts = folder, limit, bytearray(), []

    def add(self, ways: list[int]) -> None:
        self.rows += bytes(ways)
        if len(self.rows) >= 4 * self.limit:
            import uuid

            fs, base = open_fs(self.folder)
            fs.create_dir(base)
            name = f"{base}/{uuid.uuid4().hex}"  # of this attempt alone
            with fs.open_output_stream(name) as f:
                f.write(bytes(self.rows))
            self.parts.append(name)
            self.rows.clear()

    def blocks(self) -> Iterator[bytes]:
        """From the last row to the first."""
        yield bytes(self.rows)
        if self.parts:
            fs, _ = open_fs(self.folder)
            for name in reversed(self.parts):
                with fs.open_input_stream(name) as f:
                    yield f.read()
                fs.delete_file(name)

    def audit(self, state: int, inserted: int) -> str:
        out = bytearray(b"I" * inserted)
        for block in self.blocks():
            for i in range(len(block) - 4, -1, -4):
                way = block[i + state]
                out += LETTERS[way >> 4].encode() + b"I" * (way >> 2 & 3)
                state = way & 3
        out.reverse()
        return out.decode()


class Repair:
    """One conversation: rows go in by turn, ``result`` comes out."""

    def __init__(self, folder: str = "", limit: int = SPILL):
        self.last_turn = self.min_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None  # initial of the row before
        #: state -> (cost, rank of its edits among the states', SHA-256, whether anything was written)
        self.states = {START: (0, 0, hashlib.sha256(), False)}
        self.ways = _WaysBack(folder, limit)

    def _ready(self, cost_of_state):
        """(state before, inserted rows, state, cost): each state with up to two rows inserted."""
        for s, (cost, *_) in cost_of_state.items():
            yield s, 0, s, cost
            once = NEXT[s][1]
            yield s, 1, once, cost + INSERT
            yield s, 2, NEXT[once][1], cost + 2 * INSERT

    def add(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.min_turn = turn if self.min_turn is None else self.min_turn
            self.last_turn = turn
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        more = TRUNCATED if fault == "t" else 0
        best: dict[int, tuple] = {}  # state -> (cost, (rank before, letters), state before, inserted, letter, role written)

        def offer(to, cost, letter, s, inserted, written):
            got = (cost, (self.states[s][1], "I" * inserted + letter), s, inserted, letter, written)
            if to not in best or got[:2] < best[to][:2]:
                best[to] = got

        for s, inserted, at, cost in self._ready(self.states):
            offer(at, cost + DELETE, "D", s, inserted, None)
            if fault not in ("b", "d"):
                follows, to = NEXT[at]
                offer(to, cost + REROLE + more, "R", s, inserted, follows)
                if initial == follows[0]:
                    offer(to, cost + KEEP + more, "K", s, inserted, role)
                elif initial == "s" and at == START:
                    offer(AFTER_SYSTEM, cost + KEEP + more, "K", s, inserted, role)
        order = sorted(best, key=lambda to: best[to][1])
        ways, now = [0, 0, 0, 0], {}
        for rank, to in enumerate(order):
            cost, _, s, inserted, letter, written = best[to]
            ways[to] = LETTERS.index(letter) << 4 | inserted << 2 | s
            digest, any_row = self._written(s, inserted)
            if written is not None:
                digest = digest if inserted else digest.copy()
                digest.update(f"{chr(10) if any_row else ''}{written}:{text}".encode("utf-8", "surrogatepass"))
                any_row = True
            now[to] = (cost, rank, digest, any_row)
        self.states = now
        self.ways.add(ways)

    def _written(self, state: int, inserted: int):
        """The digest of a state's repaired rows with ``inserted`` empty rows after them."""
        _, _, digest, any_row = self.states[state]
        for _ in range(inserted):
            role, state = NEXT[state]
            digest = digest.copy()
            digest.update(f"{chr(10) if any_row else ''}{role}:".encode())
            any_row = True
        return digest, any_row

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        ends = [(cost, self.states[s][1], s, inserted) for s, inserted, at, cost in self._ready(self.states) if at in COMPLETE]
        cost, _, state, inserted = min(ends)
        gaps = 0 if self.min_turn is None else self.last_turn - self.min_turn + 1 - self.turns
        digest, _ = self._written(state, inserted)
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, self.ways.audit(state, inserted),
                digest.hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _plain(rows: DataFrame, *more) -> DataFrame:
    """Whole numbers without NULL (pandas would make them floats): conv_id, no_conv, turn, no_turn and other columns."""
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
    return rows.select(zero("conv_id"), F.col("conv_id").isNull().alias("no_conv"), zero("turn"),
                       F.col("turn").isNull().alias("no_turn"), *more)


def repaired(rows: DataFrame, limit: int = SPILL) -> DataFrame:
    """conv_id and ``COLUMNS`` of every conversation of ``judged`` rows."""
    folder = shared_folder(prepare(rows.sparkSession), "ways-back")

    def run(batches):
        import pandas as pd

        out, repair, conv = [], None, None

        def flush():
            got = pd.DataFrame(out, columns=["conv_id", *COLUMNS])
            got["conv_id"] = pd.array([r[0] for r in out], dtype="Int64")
            out.clear()
            return got

        for batch in batches:
            for c, no_conv, turn, no_turn, role, text, gone, fault in batch.itertuples(index=False):
                if repair is None or conv != (c, no_conv):
                    if repair is not None:
                        out.append((None if conv[1] else conv[0], *repair.result()))
                    if len(out) >= 1000:
                        yield flush()
                    repair, conv = Repair(folder, limit), (c, no_conv)
                if not gone:
                    repair.add(None if no_turn else turn, role, text, fault)
        if repair is not None:
            out.append((None if conv[1] else conv[0], *repair.result()))
            yield flush()

    return _plain(rows, "role", "text", "gone", "fault").mapInPandas(
        run, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
             "cost bigint, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, limit: int = SPILL) -> DataFrame:
    """``repaired`` for a table (conv_id, turn, role, text) as it is."""
    return repaired(judged(undamaged(conversations)), limit)


def undamaged(conversations: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", "turn", part("role"), part("text"), F.lit(False).alias("gone"))


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn, role, text, edit: the repaired conversations themselves.

    ``audits`` has conv_id and audit, as ``repaired`` gives them for ``rows``. An audit is dealt and sorted before
    the rows of its conversation, which then follow it in a stream. Inserted rows have no turn.
    """
    prepare(rows.sparkSession)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    plans = audits.select("conv_id", none("bigint", "turn"), none("string", "role"), F.col("audit").alias("text"), F.lit(0).alias("what"))
    live = rows.where(~F.col("gone")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.lit(1).alias("what"))
    both = (plans.unionByName(live).repartition("conv_id")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), "what", F.asc_nulls_first("turn"), "role", "text"))

    def run(batches):
        import pandas as pd

        out, audit, at, place, state, conv = [], "", 0, 0, START, (None, True)

        def put(turn, role, text, edit):
            nonlocal place
            out.append((None if conv[1] else conv[0], place, turn, role, text, edit))
            place += 1

        def insert():
            nonlocal at, state
            while audit[at:at + 1] == "I":
                role, state = NEXT[state]
                put(None, role, "", "I")
                at += 1

        def flush():
            got = pd.DataFrame(out, columns=["conv_id", "place", "turn", "role", "text", "edit"])
            for i, c in ((0, "conv_id"), (2, "turn")):
                got[c] = pd.array([r[i] for r in out], dtype="Int64")
            out.clear()
            return got

        for batch in batches:
            for c, no_conv, turn, no_turn, role, text, what in batch.itertuples(index=False):
                if what == 0:
                    insert()  # what the conversation before ends in
                    audit, at, place, state, conv = text, 0, 0, START, (c, no_conv)
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit != "D":
                    first = state == START and edit == "K" and role[:1] == "s"
                    follows, state = (role, AFTER_SYSTEM) if first else NEXT[state]
                    put(None if no_turn else turn, role if edit == "K" else follows, text, edit)
                if len(out) >= 5000:
                    yield flush()
        insert()
        if out:
            yield flush()

    return _plain(both, "role", "text", "what").mapInPandas(
        run, "conv_id bigint, place bigint, turn bigint, role string, text string, edit string")
