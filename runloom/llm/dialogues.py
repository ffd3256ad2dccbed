"""Conversation structure: faults of turns, and the cheapest edits that make the roles alternate.

Legal conversations have role initials ``(s?(ua)+)?``. Edits of a row are Keep (0), Rerole to user or assistant (2) and
Delete (3, the only one for blank and repeated rows); an empty user or assistant row may be Inserted anywhere (2); a truncated
row that stays costs 1 more. Of the cheapest audits (initials of the edits in order) the ASCII-least is taken.

The search runs over rows and the four states of the pattern. An audit is a chain of nodes, one for each edit, that shares
its beginning with other audits. A node knows its ancestors 1, 2, 4, … edits up and a rolling hash of all edits to it, so
two audits of equal cost are compared by a search for their longest common beginning, found by hashes and then verified
edit by edit. Audits of equal cost over the same rows are never one the beginning of the other, as the further edits would
have a cost, so keeping one audit for each state loses none. Edits that all living audits share are settled every
``SETTLE`` rows and leave the search.

Spark damages, compares and sorts the rows; a conversation passes through a task as a sorted stream, whose search holds the
rows that are not yet settled. Rows that repeat an earlier one of their conversation are found by counts over (conversation,
role, text), never by sets inside a task.

NULL ids are one conversation. NULL roles and texts are one space, NULL turns come first and are in no gap. Rows of equal turn
go by role, then text. Repeated rows are rows of their own. Empty texts are blank. An empty role has no initial: kept, it
changes nothing. An empty table gives no rows, a conversation without rows an empty audit. Other columns are ignored.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import small_side, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)
#: States: nothing yet, after system, after user, after assistant; the role initials that lead on from each.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLE = {2: "user", 3: "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
BLANKS = " \t\n\v\f\r"
BASE, PRIME = 1_000_003, (1 << 61) - 1
#: Rows between two settlements, and conversations or characters that leave a task together.
SETTLE, SLICE, SLICE_CHARS = 512, 1_000, 8_000_000


class Chains:
    """Audits as chains of edits that share their beginnings. Node 0 is the empty audit."""

    def __init__(self):
        self.edit, self.depth, self.up, self.hash = [""], [0], [()], [0]

    def grow(self, node: int, edit: str) -> int:
        ups, at, k = [node], node, 0
        while len(self.up[at]) > k:  # the ancestor 2^(k+1) up is the one 2^k up from the one 2^k up
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.up.append(tuple(ups))
        self.hash.append((self.hash[node] * BASE + ord(edit)) % PRIME)
        return len(self.edit) - 1

    def ancestor(self, node: int, depth: int) -> int:
        """The beginning of so many edits."""
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def common(self, a: int, b: int) -> tuple[int, int]:
        """The two audits' beginnings up to their longest common one: nodes with equal edits, whether shared or not."""
        low, high = 0, min(self.depth[a], self.depth[b])
        while low < high:
            middle = (low + high + 1) // 2
            x, y = self.ancestor(a, middle), self.ancestor(b, middle)
            if x == y or self.hash[x] == self.hash[y]:
                low = middle
            else:
                high = middle - 1
        x, y = self.ancestor(a, low), self.ancestor(b, low)
        return self.verified(x, y)

    def verified(self, a: int, b: int) -> tuple[int, int]:
        """The same nodes, or those before the first unequal edits where equal hashes have deceived."""
        x, y, unequal = a, b, None
        while x != y:
            if self.edit[x] != self.edit[y]:
                unequal = x, y
            x, y = self.up[x][0], self.up[y][0]
        return (a, b) if unequal is None else (self.up[unequal[0]][0], self.up[unequal[1]][0])

    def less(self, a: int, b: int) -> bool:
        """True if audit a comes before audit b."""
        if a == b:
            return False
        depth = self.depth[self.common(a, b)[0]]
        if depth in (self.depth[a], self.depth[b]):
            return self.depth[a] < self.depth[b]
        return self.edit[self.ancestor(a, depth + 1)] < self.edit[self.ancestor(b, depth + 1)]

    def edits(self, node: int, above: int = 0) -> str:
        """The edits to a node behind the node ``above``."""
        out = []
        while node != above:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def shared(self, nodes: list[int]) -> int:
        """The last node that all chains pass."""
        top, *rest = sorted(set(nodes), key=self.depth.__getitem__)
        for node in rest:
            a, b = top, self.ancestor(node, self.depth[top])
            while a != b:  # halving steps: the highest ancestors that still differ
                k = next((k for k in range(len(self.up[a]) - 1, -1, -1) if self.up[a][k] != self.up[b][k]), None)
                a, b = (self.up[a][0], self.up[b][0]) if k is None else (self.up[a][k], self.up[b][k])
            top = a
        return top


class Search:
    """The cheapest audit of one conversation, fed row by row."""

    def __init__(self):
        self.chains = Chains()
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self.settled: list[str] = []
        self.rows = 0
        self.inserts()

    def offer(self, best: list, state: int, cost: int, node: int, edit: str) -> None:
        """Keep the audit that ``edit`` makes of ``node`` if its state has none that is cheaper, or as cheap and less."""
        held = best[state]
        if held is None or cost <= held[0]:
            grown = self.chains.grow(node, edit)
            if held is None or cost < held[0] or self.chains.less(grown, held[1]):
                best[state] = cost, grown

    def inserts(self) -> None:
        for state in (0, 1, 3, 2):  # an insert after state 2 ends in 3, from where another could only cost more
            if self.best[state]:
                cost, node = self.best[state]
                for initial, after in NEXT[state].items():
                    if initial != "s":
                        self.offer(self.best, after, cost + COST[INSERT], node, INSERT)

    def row(self, initial: str, fault: int) -> None:
        after: list[tuple[int, int] | None] = [None] * 4
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self.offer(after, state, cost + COST[DELETE], node, DELETE)
            if fault in (BLANK, DUPLICATE):
                continue
            cost += fault == TRUNCATED
            if not initial:
                self.offer(after, state, cost, node, KEEP)
            elif initial in NEXT[state]:
                self.offer(after, NEXT[state][initial], cost, node, KEEP)
            for other, to in NEXT[state].items():
                if other not in ("s", initial):
                    self.offer(after, to, cost + COST[REROLE], node, REROLE)
        self.best = after
        self.inserts()
        self.rows += 1
        if self.rows % SETTLE == 0:
            self.settle()

    def settle(self) -> None:
        """Take the beginning that all living audits share out of the search."""
        living = [held[1] for held in self.best if held]
        top = self.chains.shared(living)
        self.settled.append(self.chains.edits(top))
        fresh, copies = Chains(), {top: 0}
        for node in living:
            path = []
            while node not in copies:
                path.append(node)
                node = self.chains.up[node][0]
            for x in reversed(path):
                copies[x] = node = fresh.grow(copies[self.chains.up[x][0]], self.chains.edit[x])
        self.best = [held and (held[0], copies[held[1]]) for held in self.best]
        self.chains = fresh

    def result(self) -> tuple[int, str]:
        cost, node = None, None
        for held in (self.best[state] for state in ENDS):
            if held and (cost is None or held[0] < cost or held[0] == cost and self.chains.less(held[1], node)):
                cost, node = held
        return cost, "".join(self.settled) + self.chains.edits(node)


def edited(rows: list[tuple[str, str]], audit: str) -> list[dict]:
    """The rows (role, text) after the edits of the audit."""
    out, state, left = [], 0, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(left)
        if edit == DELETE:
            continue
        if edit != KEEP:
            state = next(to for initial, to in NEXT[state].items() if initial != "s")
            role = ROLE[state]
        elif role:
            state = NEXT[state][role[0]]
        out.append({"role": role, "text": text})
    return out


class Conversation:
    """What is known of a conversation after its rows so far, in order."""

    def __init__(self, ident):
        self.ident, self.rows, self.search = ident, [], Search()
        self.low = self.high = self.initial = self.before = None
        self.turns = self.illegal = self.chars = 0
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, role: str, text: str, repeats: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial, seen = role[:1], (turn, role, text)
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        visible = text.rstrip(BLANKS)
        if not visible:
            fault = BLANK
        elif repeats or seen == self.before:
            fault = DUPLICATE
        else:
            fault = SOUND if visible[-1] in ".!?" else TRUNCATED
        self.faults[fault] += 1
        self.initial, self.before = initial, seen
        self.rows.append((role, text))
        self.chars += len(text)
        self.search.row(initial, fault)

    def result(self) -> dict:
        cost, audit = self.search.result()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.ident, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE],
                "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "cost": cost, "audit": audit,
                "repaired": edited(self.rows, audit)}


RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired array<struct<role:string,text:string>>")


def repairer(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done, chars = None, [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for ident, turn, role, text, present, repeats in zip(*columns):
                if own is None or ident != own.ident:
                    if own:
                        chars += own.chars
                        done.append(own.result())
                    if len(done) >= SLICE or chars >= SLICE_CHARS:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, chars = [], 0
                    own = Conversation(ident)
                if present:
                    own.add(turn, role, text, repeats)
        if own:
            done.append(own.result())
        yield pa.RecordBatch.from_pylist(done, schema)

    return run


def rows_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) with NULL roles and texts as one space."""
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("present"))


def damage_of(conv_id: str = "conv_id", turn: str = "turn") -> Column:
    """crc32 of ``conv_id:turn`` modulo 20, NULLs as one space."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return F.pmod(F.crc32(F.concat(part(conv_id), F.lit(":"), part(turn))), F.lit(20))


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with faults planted by ``damage_of``: 0 dropped (kept as not present), 1 emptied, 2 without `[.!?]`, 3 repeated, 4 made user."""
    own = rows_of(turns).withColumn("damage", damage_of())
    kind = F.col("damage")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = own.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                      (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text, present): faults, cost, audit and the repaired rows."""
    spark = rows.sparkSession
    keyed = rows.withColumn("same", F.when(F.col("present"), F.sha2(F.to_json(F.struct("role", "text")), 256)))
    # Only texts that a conversation holds again need their first turn; NULL turns come first.
    first = keyed.filter("present").groupBy(F.col("conv_id").alias("of"), F.col("same").alias("text_key")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = written(first, "turns-again", spark)
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    marked = keyed.join(small_side(again, again.count()), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("text_key")), "left")
    ready = marked.select("conv_id", "turn", "role", "text", "present", F.coalesce(at > F.col("first"), F.lit(False)).alias("repeats"))
    ident = ready.schema["conv_id"].dataType.simpleString()
    result = f"conv_id {ident}, {RESULT}"
    # Wide texts are sorted once, within the conversations' partitions.
    stream = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return stream.mapInArrow(repairer(arrow_schema(result)), result)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))
