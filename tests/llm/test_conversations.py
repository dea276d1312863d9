"""Secret scan, conversation repair and turn reassembly against brute force, with nulls, empties, ties, repeats and clashing columns."""

import functools
import hashlib
import random
import re
import string
import sys
import zlib


from sparkslab.llm import queries, reassembly, repair, secret_scan

TURNS = "conv_id long, turn long, role string, text string"


# ---- secrets


def base_by_hand(text):
    """The contract's patterns, plainly."""
    text = text or ""
    found = []
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for place, (kind, pattern, group, least) in enumerate([("assign", assign, 2, 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]):
        found += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [x[2] for x in sorted(found)]


def hostile_texts():
    rng = random.Random(3)
    parts = ["token", "TOKEN", "api_key", "apikey", "Secret", "passwd", "toKen", "ſecret", "=", ":", " ", "  ", "'", '"', "abcde", "abcdef", "AKIA", "AKIA" + "B7" * 8, "0123456789abcdef" * 2, "f" * 23, "\n", "é", "key ", "x/y.z-w_", "=="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return [*texts, None, "", "token=token:abcdef", "token==abcde", "password = \"hunter22\"", "a" * 200_000, "token " * 20_000 + "9z" * 30_000]


def test_patterns_by_brute_force():
    novelty = secret_scan.Novelty(b"")
    for t in hostile_texts():
        got = [f"{k}:{a}:{b}" for k, a, b, _ in secret_scan.scan_text(t, novelty) if k != "novel"]
        assert got == base_by_hand(t), repr(t)[:300]


def test_secret_scan(spark):
    rng = random.Random(4)
    names = ["request", "handler", "account", "settings", "version", "billing", "profile", "customer"]
    plain = [" ".join(rng.choice(names) for _ in range(60)) for _ in range(50)]
    random_one = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(32))
    tail = f"the private value {random_one} is used here"
    tame = "the private value settings_version_profile_2 is used here"
    far = "value " + "w " * 60 + random_one
    rows = [(i, t, "c") for i, t in enumerate([*plain, tail, tame, far, None, "", f"token = '{random_one}' and token {random_one}", "password: short1"])]
    docs = spark.createDataFrame([*rows, rows[50]], "doc_id long, text string, secrets string").repartition(3)
    dictionary = secret_scan.identifiers(docs)
    assert set(dictionary.decode().split("\n")) >= set(names)
    got = {r.doc_id: r.secrets for r in secret_scan.scan(docs).collect()}
    assert [(s.kind, tail[s.start : s.end]) for s in got[50]] == [("novel", random_one)] and got[50][0].novelty > 0.9
    assert got[51] == [] and got[52] == [] and got[53] == [] and got[54] == []
    assert [s.kind for s in got[55]] == ["assign", "novel"]
    out = secret_scan.reports(docs)
    assert out.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    by_id = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) + 1
    for i, t, _ in rows:
        base = base_by_hand(t)
        r = by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("novel")] == base
        assert r.n_assign == sum(x.startswith("assign") for x in base)
    assert secret_scan.reports(docs.limit(0)).count() == 0


def test_secret_query_by_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    got = queries.op11_secret_scan(spark, small).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = base_by_hand(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))


# ---- repair


def repair_by_hand(rows):
    """rows: (initial, fault) in order.  Dijkstra-like relaxation over all audits, by exact (cost, audit) for each suffix and grammar state."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, ""))
        if inserts < 3:
            for role in "ua":
                if (state, role) in after:
                    c, a = best(i, after[state, role], inserts + 1)
                    found.append((c + 3, "I" + a))
        if i < len(rows):
            initial, fault = rows[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 4, "D" + a))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, initial) in after:
                    c, a = best(i + 1, after[state, initial], 0)
                    found.append((c + more, "K" + a))
                for role in "ua":
                    if (state, role) in after:
                        c, a = best(i + 1, after[state, role], 0)
                        found.append((c + 3 + more, "R" + a))
        return min(found, default=(10**9, ""))

    sys.setrecursionlimit(20_000)
    return best(0, "", 0)


def test_least_edits_by_brute_force():
    rng = random.Random(5)
    names = ["fine", "blank", "duplicate", "truncated"]
    for n in [0, 1, 2, 3, 4, 5, 6, 8, 12, 20, 40]:
        for _ in range(300):
            initials = "".join(rng.choice(["s", "u", "a", " ", "x"] if rng.random() < 0.5 else ["u", "a"]) for _ in range(n))
            faults = bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
            want = repair_by_hand(tuple((i, names[f]) for i, f in zip(initials, faults, strict=True)))
            assert repair.least_edits(initials, faults) == want, (initials, faults)
    cost, audit = repair.least_edits("ua" * 100_000 + "u", bytes(200_001))
    assert cost == 3 and len(audit) in (200_001, 200_002)
    assert repair.least_edits("s" * 3000, bytes(3000))[0] == 3 * 2998 + 4


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        text = " " if text is None else text
        role = " " if role is None else role
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def report_by_hand(all_rows):
    out = {}
    after = damage_by_hand(all_rows)
    for conv in {r[0] for r in all_rows}:
        rows = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in rows:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "fine")
            seen.add((role, text))
        initials = [r[2][:1] for r in rows]
        cost, audit = repair_by_hand(tuple(zip(initials, faults, strict=True)))
        turns = [r[1] for r in rows if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        repaired, state, i = [], "", 0
        for e in audit:
            other = "assistant" if state == "u" else "user"
            if e == "I":
                repaired.append(f"{other}:")
                state = other[0]
                continue
            role, text = rows[i][2:]
            i += 1
            if e == "R":
                role = other
            if e != "D":
                repaired.append(f"{role}:{text}")
                state = role[0]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in repaired))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def conversations():
    rng = random.Random(6)
    rows = []
    for conv in [None, *range(150)]:
        said = []
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", None, "", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice([None, "", " \t\n", "Yes.", "no end", "Why?  \n", "é ", "a.b"]) if rng.random() < 0.5 else f"Said {conv} {turn}."
            said.append((conv, rng.choice([turn, turn, turn, turn + 3]), role, text))
        if rng.random() < 0.2:
            said.append((conv, None, "system", f"no turn {conv}."))
        rows += said
    rows += [(500, t, ("user", "assistant")[t % 2], f"Long {t}.") for t in range(300)]
    rows += [(501, 1, "user", "x" * 300_000 + "."), (501, 2, "assistant", " " * 100_000 + "." + " " * 100_000)]
    return rows + rows[3:6]


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair(spark):
    rows = conversations()
    turns = spark.createDataFrame([(*r, 1) for r in rows], TURNS + ", digest long").repartition(5)
    edits = repair.repair(repair.damaged(turns))
    got = repair.reports(edits).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == report_by_hand(rows) and len(got) == len({r[0] for r in rows})
    kept = [r for r in edits.collect() if r.edit is not None and r.edit != "D"]
    assert {r.role for r in kept if r.edit == "I"} <= {"user", "assistant"} and all(r.text == "" for r in kept if r.edit == "I")
    assert repair.reports(repair.repair(repair.damaged(turns.limit(0)))).collect() == []


def test_repair_query(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, small).collect()
    assert {r.conv_id: tuple(r[f] for f in FIELDS) for r in got} == report_by_hand(rows)


# ---- reassembly


def events_by_hand(rows):
    """The contract, batch by batch over all conversations."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    batches = [{} for _ in range(12)]
    first = {}
    for conv, turn, role, text in rows:
        if turn is None:
            continue
        h = int(hashlib.sha256(f"{'' if conv is None else conv}:{turn}".encode()).hexdigest()[:8], 16)
        first[conv] = min(first.get(conv, turn), turn)
        for batch, who in [(h % 12, role or "")] + [((h + 5) % 12, "user")] * (h % 7 < 2):
            one = (f"{who}|{text or ''}".encode(), who)
            batches[batch][conv, turn] = min(batches[batch].get((conv, turn), one), one)
    kept, released, last, closed, out = {}, {}, {}, set(), []

    def close(conv, batch):
        mine = kept[conv]
        waiting = sorted(t for t in mine if t not in released[conv])
        missing = sum(t not in mine for t in range(first[conv], max(mine) + 1))
        breaks = sum(mine.get(t - 1, (None, None))[1] == mine[t][1] for t in mine)
        out.append(("close", conv, -1, batch, digest(",".join(map(str, waiting))), missing, breaks))
        closed.add(conv)

    for batch, arrived in enumerate(batches):
        for (conv, turn), one in arrived.items():
            if conv in closed:
                out.append(("reject", conv, turn, batch, digest(one[0].decode()), None, None))
            else:
                kept.setdefault(conv, {}).setdefault(turn, one)
                released.setdefault(conv, set())
                last[conv] = batch
        for conv, mine in kept.items():
            if conv in closed:
                continue
            turn = first[conv]
            while turn in mine:
                if turn not in released[conv]:
                    released[conv].add(turn)
                    out.append(("release", conv, turn, batch, digest(mine[turn][0].decode()), None, None))
                turn += 1
            if batch - last[conv] >= 2:
                close(conv, batch)
    for conv in sorted(set(kept) - closed, key=str):
        close(conv, 12)
    return sorted(out, key=str)


EVENT = ["event", "conv_id", "turn", "batch", "sha256", "n_missing", "n_breaks"]


def as_rows(df):
    return sorted((tuple(r[c] for c in EVENT) for r in df.collect()), key=str)


def test_reassembly(spark):
    rng = random.Random(7)
    rows = [(conv, rng.choice([0, -3, 5]) + t, rng.choice(["user", "assistant", None, "a|b"]), rng.choice([None, "", "hé|llo", f"text {t}", "퟿", "\U0001f600", "z"])) for conv in [None, *range(40)] for t in rng.sample(range(12), rng.randint(1, 9))]
    rows += [(900, t, ("user", "assistant")[t % 2], f"long {t}") for t in range(700)]
    rows += [(901, None, "user", "no turn"), (902, 4, "user", "x" * 100_000), *rows[:20], *[(c, t, "zz", x) for c, t, _, x in rows[20:30]]]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", payload string, batch int").repartition(3)
    events = reassembly.reassembled(turns)
    assert as_rows(reassembly.digests(events)) == events_by_hand(rows)
    released = [r for r in events.collect() if r.event == "release" and r.conv_id == 900]
    assert all(r.payload == f"{r.role}|long {r.turn}" for r in released) and released


def test_reassembly_of_nothing(spark):
    assert reassembly.reassembled(spark.createDataFrame([], TURNS)).collect() == []


def test_reassembly_query(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = as_rows(queries.op13_turn_reassembly(spark, small))
    assert got == events_by_hand(rows) and {r[0] for r in got} == {"release", "reject", "close"}


def test_state_is_small_and_ordered():
    k = reassembly.Kept(3)
    for t in (9, 5, 4, 7, 5):
        k.add(t, "user", f"p{t}")
    assert list(k.released()) == [] and k.waiting() == "4,5,7,9" and k.missing() == 3
    k = reassembly.Kept(3, *k.saved())
    k.add(3, "user", "p3")
    assert [t for t, *_ in k.released()] == [3, 4, 5] and k.breaks == 2 and k.missing() == 2
    k.add(3, "assistant", "again")
    assert k.waiting() == "7,9"


