import hashlib
import heapq
import random
import zlib
from collections import defaultdict

from clausemill.llm import turns

BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, audit) by Dijkstra's search over (turns done, what the repaired turns end in)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in done:
            continue
        done.add((i, last))
        role = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*lines, f"{role}:")))
        if i < len(rows):
            mine, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, role[0], (*lines, f"{role}:{text}")))
                if mine[:1] == role[0] or mine[:1] == "s" and last == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, mine[0], (*lines, f"{mine}:{text}")))


def plainly(rows):
    by = defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        mine, seen, judged = sorted(by[conv]), set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(BLANKS)
            judged.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [r[1] for r in mine if r[0]]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, lines = cheapest(judged)
        faults = [f for _, _, f in judged]
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(spark, rows, extra=()):
    df = spark.createDataFrame([(*r, *(1 for _ in extra)) for r in rows], "conv_id long, turn long, role string, text string" + "".join(f", {c} int" for c in extra))
    rows = turns.damaged_and_repaired(df).collect()
    got = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def conversations(seed, convs, longest, roles=("system", "user", "assistant", "tool", "", None)):
    r = random.Random(seed)
    texts = ["Yes.", "no", "What?  ", " \t", "", None, "a\nb!", "naïve…", "x. "]
    return [(c, r.choice([t, t, t, None, t + 1]), r.choices(roles, [1, 6, 6, 1, 1, 1])[0], r.choice(texts) if r.random() < 0.5 else f"t{r.random()}.") for c in [*range(convs), None] for t in range(r.randrange(longest))]


def test_small_conversations_against_a_search(spark):
    rows = conversations(1, 150, 9)
    assert found(spark, rows) == plainly(rows)


def test_all_matrices_of_short_sequences():
    """Every sequence of up to four turns, folded one by one and as a tree, against the search."""
    kinds = [("s", ""), ("u", ""), ("a", "truncated"), ("a", ""), ("x", "truncated"), ("u", "duplicate")]
    rng = random.Random(2)
    for n in range(9):
        for _ in range(60):
            rows = [rng.choice(kinds) for _ in range(n)]
            cost, audit, _ = cheapest([(i, "t", f) for i, f in rows])
            cut = rng.randrange(n + 1)
            parts = []
            for some in (rows[:cut], rows[cut:]):
                m = turns.identity()
                for i, f in some:
                    m = [turns.turned(row, i, f) for row in m]
                parts.append(m)
            assert turns.cheapest(turns.product(*parts)) == (cost, audit)


def test_conversations_over_partitions(spark):
    rows = conversations(5, 3, 700, ("system", "user", "assistant", "user", "assistant", "user"))
    assert found(spark, rows) == plainly(rows)


def test_one_turn_repeated(spark):
    rows = [(7, 3, "user", "same text.")] * 500 + [(8, None, None, None)] * 3
    assert found(spark, rows) == plainly(rows)


def test_empty_table_clashing_columns_and_long_text(spark):
    assert found(spark, []) == {}
    rows = [(1, t, ["user", "assistant"][t % 2], "long text " * 50_000 + "end.") for t in range(4)]
    assert found(spark, rows, ("pos", "conv", "uid", "copy", "said", "audit")) == plainly(rows)


def test_lost_conversations_have_zeros(spark):
    lost = [(c, t, "user", "x.") for c in range(200) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert lost and found(spark, lost) == plainly(lost)
