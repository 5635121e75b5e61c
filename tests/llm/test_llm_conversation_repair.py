"""Conversation repair against exhaustive search, and its chunks against one lattice."""

import hashlib
import random
import re
import zlib

import pytest

from plumbline.llm import conversation_repair as cr

KIND = "conv_id long, turn long, role string, text string, extra int"


def cheapest(codes: str, most: int):
    """(cost, audit) over all edits with at most ``most`` insertions."""
    best, n = None, len(codes) // 2

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == n and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < most:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserted + 1)
        if i < n:
            initial, fault = codes[2 * i : 2 * i + 2]
            go(i + 1, roles, cost + 2, audit + "D", inserted)
            if fault not in "bd":
                extra = 5 * (fault == "t")
                go(i + 1, roles + initial, cost + extra, audit + "K", inserted)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + extra, audit + "R", inserted)

    go(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_search_equals_enumeration_and_chunks_change_nothing(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randint(0, 4)
        codes = "".join(rng.choice("sua-") + rng.choice("bdt...") for _ in range(n))
        cost, moves = cr.Lattice(codes).search(cr.NOTHING, cr._ENDS)
        assert (cost, cr.audit_of(moves)) == cheapest(codes, 2)
        for size in (1, 2, 3):
            parts, chunks = [], max(1, -(-n // size))
            for c in range(chunks):
                lattice = cr.Lattice(codes[2 * c * size : 2 * (c + 1) * size])
                for first in [0] if c == 0 else range(4):
                    for last in range(4) if c < chunks - 1 else cr._ENDS:
                        if (way := lattice.search(first, (last,))) is not None:
                            parts.append((c, first, last, *way))
            assert cr.joined_chunks(parts) == (cost, moves)


def _expected(rows):
    """One conversation's row by the contract, rows in order of turn."""
    seen, codes, counts = set(), "", {"b": 0, "d": 0, "t": 0}
    for _, role, text in rows:
        bare = text.rstrip(cr.SPACES)
        fault = "b" if not bare.strip(cr.SPACES) else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "."
        seen.add((role, text))
        counts[fault] = counts.get(fault, 0) + 1
        codes += (role[:1] if role[:1] in ("s", "u", "a") else "-") + fault
    cost, moves = cr.Lattice(codes).search(cr.NOTHING, cr._ENDS)
    lines, at = [], 0
    for m in moves:
        if m in "ua":
            lines.append("user:" if m == "u" else "assistant:")
            continue
        _, role, text = rows[at]
        at += 1
        if m != "D":
            lines.append(f"{ {'K': role, 'U': 'user', 'A': 'assistant'}[m] }:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, cr.audit_of(moves), hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("chunk", [cr.CHUNK, 3])
def test_repair_equals_one_pass(spark, chunk):
    rng = random.Random(9)
    said = ["Hello.", "Hi", "", " \t", "Why?", "Yes!", None, "x" * 40_000 + ".", "ä 😀"]
    rows = []
    for conv in (1, 2, 3, 4, None):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(said), 1))
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"{t}.", 1) for t in range(40)] + [rows[0]]
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair(spark.createDataFrame(rows, KIND), chunk=chunk).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, _ in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert got[conv] == _expected(mine), conv
    assert got[7][5:7] == (0, "K" * 40)


def test_damage_and_conversations_without_turns(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}. Good!", 0) for c in range(30) for t in range(8)] + [(None, None, None, None, 0)]
    df = spark.createDataFrame(rows, KIND)
    got = sorted(((r.conv_id, r.turn, r.role, r.text, r.copy) for r in cr.damage(df).collect()), key=str)
    want = []
    for c, t, role, text, _ in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if how:
            changed = (c, t, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
            want += [(*changed, k) for k in range(2 if how == 3 else 1)]
    assert got == sorted(want, key=str) and len({zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows[:-1]} & {0, 1, 2, 3, 4}) == 5
    none = cr.repair(df.where("conv_id = 1").limit(0), every=df.where("conv_id = 1")).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.repair(df.limit(0)).count() == 0
