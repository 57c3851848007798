"""Edit distances, alignment and spelling."""

from __future__ import annotations

import heapq
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.grouped import by_key

P_INSERT, P_DELETE, P_TRANSPOSE, P_SUBSTITUTE, P_DIACRITIC = 0.000524, 0.000167, 0.000091, 0.000278, 0.033395
DIACRITICS = {frozenset(p) for p in ("aą", "cć", "eę", "lł", "nń", "oó", "sś", "zż", "zź", "aá", "eé", "ií", "oö", "uü", "uú", "eè", "eê")}
_P_OK = 1 - P_INSERT - P_DELETE - P_TRANSPOSE - P_SUBSTITUTE - P_DIACRITIC


def unit_cost(op: str, a: str = "", b: str = "") -> float | None:
    """Cost of an edit, None where it isn't allowed (F1)."""
    return 0.0 if op == "accept" else 1.0


def restricted_cost(op: str, a: str = "", b: str = "") -> float | None:
    """Substitution and transposition between letters only (F2)."""
    if op in ("substitute", "transpose") and not (a.isalpha() and b.isalpha()):
        return None
    return unit_cost(op)


def probabilistic_cost(op: str, a: str = "", b: str = "") -> float | None:
    """Negative log probability of an edit."""
    if op == "accept":
        return -math.log(_P_OK)
    if op == "substitute" and frozenset(a + b) in DIACRITICS:
        return -math.log(P_DIACRITIC)
    return -math.log({"insert": P_INSERT, "delete": P_DELETE, "transpose": P_TRANSPOSE, "substitute": P_SUBSTITUTE}[op])


_ORDER = {"accept": 0, "transpose": 1, "substitute": 2, "insert": 3, "delete": 4}


def align(observed: str, correct: str, cost=unit_cost) -> tuple[float, list[tuple[str, str, str]]]:
    """Least cost and one edit script from correct to observed; ties by _ORDER."""
    n, m = len(observed), len(correct)
    best: list[list[tuple | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, None)
    for i in range(n + 1):
        for j in range(m + 1):
            options = []
            if i and j:
                op = "accept" if observed[i - 1] == correct[j - 1] else "substitute"
                options.append((op, 1, 1))
            if i > 1 and j > 1 and observed[i - 1] == correct[j - 2] and observed[i - 2] == correct[j - 1] and observed[i - 1] != observed[i - 2]:
                options.append(("transpose", 2, 2))
            if i:
                options.append(("insert", 1, 0))
            if j:
                options.append(("delete", 0, 1))
            found = []
            for op, di, dj in options:
                before, a, b = best[i - di][j - dj], observed[i - di : i], correct[j - dj : j]
                price = cost(op, a, b)
                if before is not None and price is not None:
                    found.append((before[0] + price, _ORDER[op], (op, a, b, i - di, j - dj)))
            if found:
                value, _, step = min(found)
                best[i][j] = (value, step)
    if best[n][m] is None:
        return math.inf, []
    script, i, j = [], n, m
    while best[i][j][1]:
        op, a, b, i, j = best[i][j][1]
        script.append((op, a, b))
    return best[n][m][0], script[::-1]


_COSTS = {"unit": unit_cost, "restricted": restricted_cost, "probabilistic": probabilistic_cost}


def aligned(pairs: DataFrame, kind: str = "unit") -> DataFrame:
    """pairs (observed, correct and more) with ``cost`` and ``edits``."""

    def run(batches):
        for pdf in batches:
            got = [align(o or "", c or "", _COSTS[kind]) for o, c in zip(pdf.observed, pdf.correct)]
            yield pdf.assign(cost=[g[0] for g in got], edits=[[{"op": o, "observed": a, "correct": b} for o, a, b in g[1]] for g in got])

    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes) + ", cost double, edits array<struct<op:string,observed:string,correct:string>>"
    return pairs.mapInPandas(run, schema)


def edit_classes(pairs: DataFrame) -> DataFrame:
    """Counts and shares of edits by operation and kind of character."""
    edits = aligned(pairs).select(F.explode("edits").alias("e"))
    char = F.coalesce(F.when(F.col("e.correct") != "", F.substring("e.correct", 1, 1)), F.substring("e.observed", 1, 1))
    kind = F.when(char.rlike(r"^\p{L}$"), "letter").when(char.rlike(r"^\p{N}$"), "digit").when(char.rlike(r"^\s$"), "space").otherwise("sign")
    return edits.groupBy(F.col("e.op").alias("op"), kind.alias("kind")).agg(F.count("*").alias("n"))


def deletions(word: Column) -> Column:
    """The word and every word one character shorter."""
    less = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.right(word, F.length(word) - i)))
    return F.array_distinct(F.concat(F.array(word), less))


def within_one(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of distinct words at edit distance 1 or 0 (F1 as a join): words one edit apart share a deletion.

    left: word; right: word. No pair is compared that shares none.
    """
    a = left.select(F.col("word").alias("a"), F.explode(deletions(F.col("word"))).alias("key"))
    b = right.select(F.col("word").alias("b"), F.explode(deletions(F.col("word"))).alias("key"))
    pairs = a.join(b, "key").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b", 1)).filter("distance >= 0")


class Trie:
    """Words of a dictionary for the beam (F5); any sign may follow a word."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = True


def beam_correct(line: str, trie: Trie, band: int = 7, width: int = 40, limit: float = 5000.0) -> str:
    """Cheapest reading of a line as words of the trie, spaces and signs between.

    Lines of fewer than 8 bytes come back as they are, others in lower case; at each
    position at most ``width`` states are expanded, in order of cost. No reading: "".
    """
    if len(line.encode()) < 8:
        return line
    text = line.lower()
    waiting: list[list] = [[] for _ in range(len(text) + 1)]
    tick = 0

    def push(at: int, cost: float, node: dict, out: str) -> None:
        nonlocal tick
        if cost <= limit and at <= len(text) and abs(len(out) - at) <= band:
            heapq.heappush(waiting[at], (cost, tick, node, out))
            tick += 1

    push(0, 0.0, trie.root, "")
    ok, ins, dele = probabilistic_cost("accept"), probabilistic_cost("insert"), probabilistic_cost("delete")
    for at in range(len(text) + 1):
        seen: dict[tuple[int, str], bool] = {}
        expanded = 0
        while waiting[at] and expanded < width:
            cost, _, node, out = heapq.heappop(waiting[at])
            key = (id(node), out[-12:])
            if key in seen:
                continue
            seen[key] = True
            expanded += 1
            if at == len(text):
                if "" in node or node is trie.root:
                    return out
            else:
                ch = text[at]
                if ch in node and ch:
                    push(at + 1, cost + ok, node[ch], out + ch)
                if not ch.isalpha() and ("" in node or node is trie.root):  # a word may end before a sign
                    push(at + 1, cost + ok, trie.root, out + ch)
                push(at + 1, cost + ins, node, out)  # an extra character was typed
                if at + 1 < len(text) and text[at + 1] in node and ch in node[text[at + 1]] and ch != text[at + 1]:
                    push(at + 2, cost + probabilistic_cost("transpose"), node[text[at + 1]][ch], out + text[at + 1] + ch)
                for want, below in node.items():
                    if want and want != ch:
                        push(at + 1, cost + probabilistic_cost("substitute", ch, want), below, out + want)
            for want, below in node.items():
                if want:
                    push(at, cost + dele, below, out + want)
    return ""


def corrected(lines: DataFrame, words: list[str], line: str = "line") -> DataFrame:
    """lines with ``corrected``; the dictionary is the caller's, of a size to send to every task."""
    schema = ", ".join(f"`{n}` {t}" for n, t in lines.dtypes) + ", corrected string"

    def run(batches):
        trie = Trie(words)
        for pdf in batches:
            yield pdf.assign(corrected=[beam_correct(x or "", trie) for x in pdf[line]])

    return lines.mapInPandas(run, schema)


def within(a: str, b: str, limit: int) -> bool:
    """Whether ``align`` at unit cost takes at most ``limit`` edits (F9): the cells within ``limit`` of the diagonal, two lines of them.

    No line of cells is lower than the lower of the two before it, so two above the limit end it.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return False
    over = limit + 1
    before: list[int] = []
    last = [min(j, over) for j in range(m + 1)]
    low = 0
    for i in range(1, n + 1):
        row = [over] * (m + 1)
        if i <= limit:
            row[0] = i
        x = a[i - 1]
        for j in range(max(1, i - limit), min(m, i + limit) + 1):
            y = b[j - 1]
            best = last[j - 1] + (x != y)
            if last[j] < best:
                best = last[j] + 1
            if row[j - 1] < best:
                best = row[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and before[j - 2] < best:
                best = before[j - 2] + 1
            row[j] = best if best < over else over
        now = min(row[max(0, i - limit) : min(m, i + limit) + 1])
        if now > limit and low > limit:
            return False
        before, last, low = last, row, now
    return last[m] <= limit


def align_transcripts(observed: DataFrame, correct: DataFrame, limit: int = 20) -> DataFrame:
    """Lines of two transcripts by time and speaker, paired in order if at most ``limit`` edits apart.

    Both: time, speaker, seq, line. Groups are the lines of one time stamp and speaker.
    """

    def run(c):
        out = []
        right = [line for side, line in zip(c["side"], c["line"]) if side == 1]
        for side, line in zip(c["side"], c["line"]):
            if side == 0:
                for i, other in enumerate(right):
                    if within(line, other, limit):
                        out.append((line, other))
                        right = right[i + 1 :]
                        break
        n = len(out)
        return {"time": c["time"][:1] * n, "speaker": c["speaker"][:1] * n, "observed": [o for o, _ in out], "correct": [o for _, o in out]}

    sides = [df.select("time", "speaker", F.lit(i).alias("side"), "seq", F.coalesce("line", F.lit("")).alias("line")) for i, df in enumerate((observed, correct))]
    return by_key(sides[0].unionByName(sides[1]), ["time", "speaker"], ["side", "seq"], run, "time string, speaker string, observed string, correct string")


def edit_counts(script: list[tuple[str, str, str]]) -> Counter:
    return Counter(op for op, _, _ in script)
