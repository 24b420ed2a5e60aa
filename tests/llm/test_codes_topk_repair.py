"""Vector codes, exact top-k search and conversation repair against SQL and brute force, on odd inputs."""

import hashlib
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import codes, repair, topk

E = "vec_id bigint, embedding array<float>, label int"


def sql(oracle, **tables):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t)
    return sorted(map(tuple, c.execute(oracle).fetchall()), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def vectors(rows):
    return pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})


def odd_vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(v) for v in rng.normal(0, 0.2, dims).astype(np.float32)], int(i) % 3 if i % 5 else None) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    bad = [(900, None, 1), (901, [nan] * dims, 1), (902, [None] + [0.5] * (dims - 1), 2), (903, [inf] * dims, None)]
    copies = [(1000 + i, rows[i][1], 2) for i in range(5)] + [(7, rows[8][1], 0), (7, rows[8][1], 0)]
    return rows + bad + copies


def test_codes_equal_sql(spark):
    rows = odd_vectors(150, 32)
    df = spark.createDataFrame(rows, E).repartition(5).withColumnRenamed("label", "Label").selectExpr("*", "1 as code", "2 as id", "3 as size", "4 as error")
    assert got(codes.code_vectors(df)) == sql(codes.ORACLE, embeddings=vectors(rows))


def test_codes_of_few_rows_other_lengths_and_null_ids(spark):
    few = odd_vectors(9, 16)
    assert got(codes.code_vectors(spark.createDataFrame(few, E))) == sql(codes.ORACLE, embeddings=vectors(few))
    assert codes.code_vectors(spark.createDataFrame([], E)).count() == 0
    assert codes.code_vectors(spark.createDataFrame([(1, None, 1)], E)).count() == 0
    mixed = spark.createDataFrame([(0, [1.0] * 5, 1), (1, [0.5] * 16, 1), (None, [0.25] * 16, 1), (3, [], None), (4, [1.0] * 32, None)], E)
    found = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in codes.code_vectors(mixed).collect()}
    assert found == {0: (None, None, 0), 1: ("00" * 16, 0, 0), None: ("01" * 16, 0, 0), 3: (None, None, None), 4: (None, None, None)}


def test_codes_of_huge_numbers_are_exact(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(0, 1e15, 16)], 1) for i in range(70)]
    rows += [(100, [1e300] * 16, 2), (101, [-1e300] * 16, 2)]
    df = spark.createDataFrame(rows, E.replace("float", "double")).repartition(3)
    whole = [[int(v) * 256 if abs(v) > 2**52 else math.floor(v * 256) for v in r[1]] for r in rows]
    book = [[[whole[e][p]] for e in range(64)] for p in range(16)]
    for turn in range(3):
        code = [[min(range(64), key=lambda e: ((w[p] - book[p][e][0]) ** 2, e)) for p in range(16)] for w in whole]
        error = [sum((w[p] - book[p][c[p]][0]) ** 2 for p in range(16)) for w, c in zip(whole, code)]
        if turn < 2:
            for p in range(16):
                for e in range(64):
                    own = [w[p] for w, c in zip(whole, code) if c[p] == e]
                    book[p][e] = [sum(own) // len(own)] if own else book[p][e]
    found = {r["vec_id"]: r for r in codes.code_vectors(df).collect()}
    for r, c, e in zip(rows, code, error):
        assert (found[r[0]]["code"], found[r[0]]["error"]) == ("".join(f"{x:02x}" for x in c), min(e, codes.LONGEST))
    digest = hashlib.sha256(",".join(str(book[p][e][0]) for p in range(16) for e in range(64)).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in found.values()} == {digest}


def test_codes_reject_more_entries_than_two_digits(spark):
    with pytest.raises(ValueError):
        codes.code_vectors(spark.createDataFrame([(1, [0.5] * 16, 1)], E), entries=300)


def test_topk_equals_sql(spark):
    rows = odd_vectors(300, 24) + [(40, [0.0] * 24, 1), (60, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows, E).repartition(7).selectExpr("*", "1 as row", "2 as `Rank`", "3 as score", "4 as at")
    assert got(topk.search_multiples(df)) == sql(topk.ORACLE, embeddings=vectors(rows))
    assert topk.search_multiples(spark.createDataFrame([], E)).count() == 0
    alone = spark.createDataFrame([(20, [0.5], 1), (21, None, 1)], E)
    assert topk.search_multiples(alone).count() == 0


def test_topk_over_many_shards_and_runs(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "LEAST_BLOCK", 3)
    rows = odd_vectors(400, 12, seed=3)
    # sparse vectors: most components are below one unit
    rows = [(i, v if not v or i % 2 else [x if k % 5 == i % 5 else 0.001 for k, x in enumerate(v)], c) for i, v, c in rows]
    df = spark.createDataFrame(rows, E).repartition(9)
    assert got(topk.search_multiples(df, every=4)) == sql(topk.ORACLE.replace("% 20", "% 4"), embeddings=vectors(rows))


def test_topk_lengths_null_ids_and_huge_numbers(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (None, [1.0], 1), (2, [], 1), (20, [-1.0, -1.0, 5.0], 1), (3, [1e30, 0.0], 1), (5, [-1e30], 1)]
    found = got(topk.search_multiples(spark.createDataFrame(rows, E)))
    big = (1 << 63) - 1
    assert [r for r in found if r[0] == 0] == [(0, 1, 3, big), (0, 2, 1, 4096), (0, 3, None, 4096), (0, 4, 2, 0), (0, 5, 20, -3 * 4096), (0, 6, 5, -big - 1)]
    assert [r[2] for r in found if r[0] == 20] == [5, 2, 1, None, 0, 3]


ROLES = ["user", "assistant", "system", "tool", "User", "", None]
TEXTS = ["Yes.", "No", "  ", None, "a.b!", "what?\n", "", " ", "x. y"]


def conversations(n, most, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(0, most + 1))):
            turn = None if rng.random() < 0.1 else int(t * rng.integers(1, 3))
            rows.append((c if c else None, turn, ROLES[int(rng.integers(0, len(ROLES)))], TEXTS[int(rng.integers(0, len(TEXTS)))]))
    return rows


C = "conv_id bigint, turn bigint, role string, text string"


def arrow(rows):
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())))})


def test_repair_equals_sql(spark):
    rows = conversations(300, 14, 5)
    rows += rows[:40]  # repeated rows
    df = spark.createDataFrame(rows, C).repartition(6).selectExpr("*", "1 as fault", "2 as digest", "3 as `Again`", "4 as audit")
    assert got(repair.repair(df)) == sql(repair.ORACLE, conversations=arrow(rows))
    assert repair.repair(spark.createDataFrame([], C)).count() == 0


def brute(rows):
    """Every list of edits with two insertions at most between turns."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not ends else "duplicate" if (role, text) in seen else "truncated" if ends[-1] not in ".!?" else None)
        seen.add((role, text))
    gaps = [x for k in range(3) for x in itertools.product(["user", "assistant"], repeat=k)]
    best = None
    for edits in itertools.product(["K", "user", "assistant", "D"], repeat=len(rows)):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out, sound = 2 * len(inserted[0]), "I" * len(inserted[0]), [f"{r}:" for r in inserted[0]], True
            for (_, _, role, text), fault, e, more in zip(rows, faults, edits, inserted[1:]):
                if e != "D":
                    sound &= fault not in ("blank", "duplicate")
                    out.append(f"{role if e == 'K' else e}:{text}")
                    cost += (fault == "truncated") + (0 if e == "K" else 2)
                else:
                    cost += 3
                audit += (e if e in "KD" else "R") + "I" * len(more)
                cost += 2 * len(more)
                out += [f"{r}:" for r in more]
            initials = "".join(x[:1] if not x.startswith(":") else "?" for x in out)
            if sound and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
    return faults, best


def test_repair_equals_all_edits(spark):
    rows = conversations(60, 3, 9)
    df = spark.createDataFrame(rows, C)
    found = {r["conv_id"]: r for r in repair.repair(df, damage=False).collect()}
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((c, t, " " if role is None else role, " " if text is None else text))
    for c, mine in own.items():
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
        if len(mine) > 3:
            continue
        faults, (cost, audit, digest) = brute(mine)
        r = found[c]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, digest)
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        turns = [t for _, t, _, _ in mine if t is not None]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r["illegal"] == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))


def test_repair_of_long_conversations_and_of_none_left(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(3000)] + [(2, i, "tool", f"turn {i}") for i in range(1500)]
    gone = next(i for i in range(1000) if zlib.crc32(f"3:{i}".encode()) % 20 == 0)
    rows.append((3, gone, "user", "Hello."))
    whole = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, C), damage=False).collect()}
    assert (whole[1]["cost"], whole[1]["audit"]) == (0, "K" * 3000)
    assert (whole[2]["cost"], whole[2]["audit"]) == (4500, "D" * 1500)  # to delete costs what another role and the cut end do
    hurt = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, C)).collect()}
    assert tuple(hurt[3])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(repair.repair(spark.createDataFrame(rows[:900], C))) == sql(repair.ORACLE, conversations=arrow(rows[:900]))
