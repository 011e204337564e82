import hashlib
import itertools
import random
import re
import zlib

from quayside.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, n int, part int, copies string"
LEGAL_END = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """(role, text, fault) of ordered (turn, role, text) rows."""
    seen, out = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """Every string of edits up to the cost of deleting all rows, tried out."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for letters in itertools.product("KRD", repeat=len(rows)):
            audit, cost = "I" * inserts[0], 3 * sum(inserts)
            for (_, _, fault), letter, more in zip(rows, letters, inserts[1:]):
                if letter != "D" and fault in ("blank", "duplicate"):
                    break
                audit += letter + "I" * more
                cost += {"K": 0, "R": 3, "D": 4}[letter] + 3 * (letter != "D" and fault == "truncated")
            else:
                if (best is None or (cost, audit) < best) and legal(rows, audit):
                    best = (cost, audit)
    return best


def legal(rows, audit):
    return any(LEGAL_END.fullmatch("".join(r[:1] for r, _ in lines)) for lines in outcomes(rows, audit))


def outcomes(rows, audit):
    """All (role, text) results that letters may stand for."""
    results, following = [[]], iter(rows)
    for letter in audit:
        role, text, _ = ("", "", "") if letter == "I" else next(following)
        choices = [] if letter == "D" else [role] if letter == "K" else ["user", "assistant"]
        results = [done + [(r, text)] for done in results for r in choices] if choices else results
        results = [done for done in results if re.fullmatch("s?(ua)*u?", "".join(r[:1] for r, _ in done))]
    return results


def stepwise(rows):
    """As :func:`cheapest`, by the best string per state; for conversations of any length."""
    nothing = {0: (0, "")}

    def inserted(ways):
        ways = dict(ways)
        for _ in range(3):
            for p, q in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if p in ways:
                    found = (ways[p][0] + 3, ways[p][1] + "I")
                    ways[q] = min(ways.get(q, found), found)
        return ways

    ways = inserted(nothing)
    for role, _, fault in rows:
        following = {}
        for p, (cost, letters) in ways.items():
            moves = [(p, 4, "D")]
            if fault in ("", "truncated"):
                price = 3 * (fault == "truncated")
                moves.append((3 if p == 2 else 2, 3 + price, "R"))
                kept = {"s": 1 if p == 0 else None, "u": 2 if p != 2 else None, "a": 3 if p == 2 else None}.get(role[:1])
                moves += [(kept, price, "K")] if kept else []
            for q, more, letter in moves:
                found = (cost + more, letters + letter)
                following[q] = min(following.get(q, found), found)
        ways = inserted(following)
    return min(ways[q] for q in (0, 3) if q in ways)


def expected(original, search):
    ids = {row[0] for row in original}
    by_id = {conv: [] for conv in ids}
    for conv, *row in damage(original):
        by_id[conv].append(tuple(row))
    out = []
    for conv, rows in by_id.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {turn for turn, _, _ in rows if turn is not None}
        judged = faults(rows)
        cost, audit = search(judged)
        lines = next(done for done in outcomes(judged, audit) if LEGAL_END.fullmatch("".join(r[:1] for r, _ in done)))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(sum(f == kind for _, _, f in judged) for kind in ("blank", "duplicate", "truncated")),
            sum(pair not in ("su", "ua", "au") for pair in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    columns = "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    table = spark.createDataFrame([(*row, "x", 1, 2, "y") for row in rows], SCHEMA).repartition(3)
    pieces = cr.repair(cr.damaged(table), **options)
    return sorted((tuple(r) for r in cr.summary(pieces).select(*columns).collect()), key=repr)


def test_short_conversations_against_every_edit(spark):
    dice = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(dice.randrange(1, 5)):
            turn = dice.choice([turn, turn, turn, turn + 2, None])
            rows.append((conv, turn, dice.choice(["user", "assistant", "system", "tool", None]), dice.choice(["Yes.", "No!", "cut", " ", None, "why?\n", "\x1c"])))
    assert got(spark, rows) == expected(rows, cheapest)


def test_long_conversations_in_blocks(spark):
    dice = random.Random(4)
    rows = []
    for conv, odd in ((1, 0.0), (2, 0.1), (3, 0.6), (None, 0.3), (-5, 1.0)):
        for turn in range(dice.randrange(150, 260)):
            role = "tool" if conv == -5 else ["user", "assistant"][turn % 2] if dice.random() > odd else dice.choice(["user", "assistant", "system", "", "tool"])
            rows.append((conv, turn, role, f"Text {turn}." if dice.random() > odd / 2 else dice.choice(["cut", "", "Text 3.", "Again."])))
    # Identical rows, and a conversation all of whose rows are dropped.
    rows += [(7, None, "user", "Same.")] * 500 + [(7, 1, "assistant", "Well.")]
    dropped = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    rows += [(8, dropped, "user", "Gone."), (9, 0, "assistant", "long " * 300_000)]
    want = expected(rows, stepwise)
    for block_rows in (4096, 7):
        assert got(spark, rows, block_rows=block_rows) == want


def test_no_rows(spark):
    assert got(spark, []) == []


def test_both_searches_agree():
    dice = random.Random(6)
    for _ in range(300):
        rows = [(dice.choice(["user", "assistant", "system", "x"]), "", dice.choice(["", "", "truncated", "blank"])) for _ in range(dice.randrange(5))]
        assert stepwise(rows) == cheapest(rows)


def test_decided_edits_leave_the_tree():
    search = cr.Survivors(cr.NOTHING)
    search.advance(cr.START)
    out = []
    for at in range(20_000):
        search.advance(cr.row_arcs("ua"[at % 2], ""))
        if at % 64 == 0:
            out += search.decided()
    held, nodes = set(search.leaves.values()), set()
    while held:
        node = held.pop()
        if node is not None and node not in nodes:
            nodes.add(node)
            held.add(node.parent)
    assert len(nodes) < 200 and len(out) > 19_900
    cost, rest = search.finish(cr.ENDS)
    assert cost == 0 and "".join(letters for _, letters in out + rest) == "K" * 20_000
