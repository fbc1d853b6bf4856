"""Splits by sitting, linked names and overlaps, with the dirty cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import names, speech
from lectern.llm import entity_link, overlap, splits


@pytest.mark.parametrize(("a", "b", "same"), [
    (("10th May, 1970P_53", 1970), ("10TH MAY, 1970P_53", 1970), True), (("10th May, 1970P_53", 1970), ("10th Mayy, 1970P_53", None), True), (("10th May, 1970P_53", None), (" 10th  May,1970P_53.txt", 1970), True),
    (("10th May, 1970P_53", None), ("1970-05-10_P053", None), True), (("10th May, 1970P_53", None), ("May 10th 70 - pg 53", 1970), True), (("10th May, 1970P_53", None), ("10-May-1970 page 53", None), True),
    (("10th May, 1970P_53", None), ("10th May, 1970P_54", None), False), (("10th May, 1970P_53", None), ("11th May, 1970P_53", None), False), (("Vol 78 No. 1", 1978), ("VOL.78-NUMBER 0001", 1978), True),
    (("Vol 78 No. 1", 1978), ("78 VOL - NUMBR 1", 1978), True), (("Vol 78 No. 1", 1978), ("vol_78_num_1.txt", 1979), False), (("Volume 78, Number 1", 1978), ("VOL. 78 - NUMBER 1", 1978), True),
    (("Feb 28th 11 - pg 87", 2011), ("28TH FEBRUARY, 2011P_87", 2011), True), (("15th Setember, 2001P_76", None), ("15th September, 2001P_76", 2001), True), (("other", None), ("Other.txt", None), True),
])
def test_sitting_keys(a, b, same):
    assert (splits.sitting_key(*a) == splits.sitting_key(*b)) is same


def _records(spark, groups):
    rows = [(f, 1970 + g) for g, fs in enumerate(groups) for f, n in fs for _ in range(n)]
    return spark.createDataFrame(rows, "file string, year int")


def test_assign_splits(spark):
    rng = random.Random(1)
    groups = [[(f"Vol {g} No. {g}", rng.randint(1, 30)), (f"vol_{g}_num_{g}.txt", rng.randint(1, 30))] for g in range(1, 60)]
    df = _records(spark, [[]] + groups)
    got = splits.assign_splits(df).collect()
    assert len(got) == 118
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.split)
    assert len(by) == 59 and all(len(s) == 1 for s in by.values())
    total = sum(r.n for r in got)
    for s, want in splits.SHARES.items():
        assert abs(sum(r.n for r in got if r.split == s) / total - want) < 0.03
    # later: new forms of known sittings keep their split, two that are merged by a new form are set aside
    state = spark.createDataFrame([(r.file, r.component, r.split) for r in got], "file string, component string, split string")
    again = splits.assign_splits(_records(spark, [[]] + [[*g, (f"{k} VOL - NUMBR {k}", 5)] for k, g in enumerate(groups, 1)]), state)
    old = {r.file: r.split for r in got}
    for r in again.collect():
        assert r.split == old.get(r.file, r.split)
    torn = state.withColumn("component", F.when(F.col("file") == "Vol 3 No. 3", "other").otherwise(F.col("component"))).withColumn("split", F.when(F.col("file") == "Vol 3 No. 3", "dev").otherwise(F.when(F.col("file") == "vol_3_num_3.txt", "train").otherwise(F.col("split"))))
    back = {r.file: r.split for r in splits.assign_splits(df, torn).collect()}
    assert back["Vol 3 No. 3"] == back["vol_3_num_3.txt"] == "quarantine"


def test_splits_of_a_batch_of_new_records(spark, tmp_path):
    path = f"file://{tmp_path}/splits"
    first = splits.update_splits(_records(spark, [[]] + [[(f"Vol {g} No. {g}", 10 + g % 7)] for g in range(1, 60)]), path).collect()
    old = {r.file: r for r in first}
    # new spellings only, some without a year or before the old name in order, and new sittings
    rows = [(f"{g} VOL - NUMBR {g}", 1970 + g) for g in range(1, 30)] + [("Vol 40 No. 40", None)] * 3 + [(f"vol_{g}_num_{g}.txt", 1970 + g) for g in range(60, 90) for _ in range(12)] + [(None, 1970)]
    got = splits.update_splits(spark.createDataFrame(rows, "file string, year int"), path).collect()
    by = {r.file: r for r in got}
    assert len(got) == len(by) == 59 + 29 + 30
    for f, r in old.items():
        assert (by[f].split, by[f].component, by[f].n) == (r.split, r.component, r.n + 3 * (f == "Vol 40 No. 40"))
    for g in range(1, 30):
        assert (by[f"{g} VOL - NUMBR {g}"].split, by[f"{g} VOL - NUMBR {g}"].component) == (old[f"Vol {g} No. {g}"].split, old[f"Vol {g} No. {g}"].component)
    total = sum(r.n for r in got)
    assert total == sum(r.n for r in first) + len(rows) - 1
    for s, want in splits.SHARES.items():
        assert abs(sum(r.n for r in got if r.split == s) / total - want) < 0.03
    # a third batch still knows the first one
    third = {r.file: r for r in splits.update_splits(spark.createDataFrame([("Volume 50, Number 50", 2020)], "file string, year int"), path).collect()}
    assert len(third) == 119 and third["Volume 50, Number 50"].split == old["Vol 50 No. 50"].split


def test_splits_of_nothing(spark):
    empty = spark.createDataFrame([], "file string, year int")
    assert splits.assign_splits(empty).count() == 0 and splits.sitting_pairs(empty).count() == 0
    nulls = spark.createDataFrame([(None, 1970), ("Vol 1 No. 2", None)], "file string, year int")
    assert [r.file for r in splits.assign_splits(nulls).collect()] == ["Vol 1 No. 2"]


def test_components_of_chains(spark):
    links = [(f"n{i:03d}", f"k{j}") for i in range(100) for j in (i, i + 1)] + [("z", "y"), ("z", None), (None, "k3")]
    got = {r.file: r.component for r in splits.components(spark.createDataFrame(links, "file string, key string")).collect()}
    assert set(got.values()) == {"n000", "z"} and len(got) == 101


LABELS = [
    ("Mr. Wernochum: x", 1), ("OLIVEIR WERNOCHUM: x", 1), ("Wernochum, Oliver Sintor:- x", 1), ("Sintor Oliver Wernochum - x", 1), ("Ollie Wernochum; x", 1), ("Wernochum O.S.: x", 1), ("Mhe. Wern.: x", 1),
    ("Hon. Oli. Wer nochum: x", 1), ("Dr. Wernochum: x", None), ("Mr. X. Wernochum: x", None), ("The Speaker: x", None), ("Speaker 4: x", None), ("<b>[00:01:02] Dot Nenalre asked the Minister for Roads why", 2),
    ("Hon. Kimdeshur: x", None), ("Capt. Kimdeshur: x", 4), ("D. F. Kimdeshur said", None), ("Hon. D. F. Kimdeshur: x", 3), ("The Member for Pufukum (Hon. Kimdeshur): x", 3), ("The Minister for Roads (Hon. Kate Mwewebul): x", 5),
    ("Hon. Mwewbul (Minister for Roads): x", 5), ("I saw Mr. Wernochum there.", None), ("Note well: x", None), ("", None), (None, None), ("Hon. Paulo: x", None),
]


def test_link_names(spark, members):
    rows = [(i, t, "extra", "key") for i, (t, _) in enumerate(LABELS)] + [(0, LABELS[0][0], "again", "key")]
    df = spark.createDataFrame(rows, "rec_id long, text string, member_id string, key string")
    got = {r.rec_id: r.member_id for r in entity_link.link_names(df, members).collect()}
    want = {i: m for i, (_, m) in enumerate(LABELS) if m}
    assert {LABELS[i][0]: got.get(i) for i in range(len(LABELS)) if got.get(i) != want.get(i)} == {}
    assert entity_link.link_names(df.limit(0), members).count() == 0
    assert entity_link.link_names(df, members.limit(0)).count() == 0


WORDS = "the board has licensed many fertile quarries at mipona since nineteen seventy and it is known that our union must reopen some idle sugar quotas before next long rains begin here again without any help from traders".split()


def _texts():
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(28, 60)) + [f"n{i}", f"m{i}"]) for i in range(120)]
    rows = []
    for i, t in enumerate(base):
        w = t.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "really"
        rows.append((2 * i, "tr", t))
        rows.append((2 * i + 1, "de", "Hon. Kimdeshur: " + " ".join(w).capitalize().replace("board", "[Laughter] board") + "."))
    rows += [(1000, "tr", "short text"), (1001, "de", "short text"), (1002, "tr", None), (1003, None, base[0]), (1004, "zz", base[0]), (0, "tr", base[0]), (1005, "de", base[0]), (1006, "de", base[0])]
    return rows


def test_overlaps_against_brute_force(spark, members):
    given = entity_link.register_given(members)
    rows = _texts()
    df = spark.createDataFrame(rows, "rec_id long, file string, text string").withColumn("seq", F.lit(1))
    sp = spark.createDataFrame([("tr", "train"), ("de", "dev"), (None, "dev")], "file string, split_name string")
    got = {(r.rec_id_a, r.rec_id_b) for r in overlap.overlap_pairs(df, sp, given).collect()}
    w = {i: (f, overlap.plain_words(t, given)) for i, f, t in rows}
    want = set()
    for i, (f, a) in w.items():
        for j, (g, b) in w.items():
            if f == "tr" and g == "de" and len(a) >= 28 and len(b) >= 28:
                m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for x in range(len(a)):
                    for y in range(len(b)):
                        m[x + 1][y + 1] = m[x][y] + 1 if a[x] == b[y] else max(m[x][y + 1], m[x + 1][y])
                if m[-1][-1] >= 0.85 * max(len(a), len(b)):
                    want.add((min(i, j), max(i, j)))
    assert got == want and len(want) >= 120
    rep = {r.file: r for r in overlap.overlap_report(df, sp, given).collect()}
    assert rep["de"].overlapping == 122 and rep["tr"].overlapping == 120 and 0.9 < rep["de"].mean_coverage <= 1
    assert overlap.overlap_pairs(df.limit(0), sp, given).count() == 0


def test_overlaps_within_a_large_group_of_near_copies(spark, members, monkeypatch):
    monkeypatch.setattr(overlap, "FEW", 50, raising=False)  # so that these are frequent
    # all seeds of the group are frequent
    given = entity_link.register_given(members)
    rng = random.Random(11)
    rows = []
    for g, size in enumerate((28, 40)):
        base = [f"w{g}x{i}" for i in range(size)]
        for i in range(240):
            w = list(base)
            for at in rng.sample(range(size), 2):
                w[at] = f"c{g}y{i}z{at}"
            rows.append((1000 * g + i, "tr" if i % 2 else "de", " ".join(w)))
    df = spark.createDataFrame(rows, "rec_id long, file string, text string")
    sp = spark.createDataFrame([("tr", "train"), ("de", "dev")], "file string, split_name string")
    got = {(r.rec_id_a, r.rec_id_b) for r in overlap.overlap_pairs(df, sp, given).collect()}
    codes = {}
    w = {i: (f, [codes.setdefault(x, len(codes)) for x in overlap.plain_words(t, given)]) for i, f, t in rows}
    near = set()
    for i, (f, a) in w.items():
        for j, (g, b) in w.items():
            if f == "tr" and g == "de" and overlap.common(np.array(a), np.array(b)) >= 0.85 * max(len(a), len(b)):
                near.add((min(i, j), max(i, j)))
    assert len(near) > 20_000 and got == near


@pytest.mark.parametrize("n", range(28, 32))
def test_texts_with_even_changes_share_a_seed(n):
    """The most single words that SHARE allows, spread so that no run of equal words is longer than it must be."""
    e = int(n * 0.15 + 1e-6)
    rng = np.random.default_rng(n)
    for _ in range(20):
        a = rng.integers(0, 1 << 24, n).astype(np.uint64)
        b = a.copy()
        b[[round((k + 1) * (n - e) / (e + 1)) + k for k in range(e)]] = rng.integers(1 << 24, 1 << 25, e)
        row = np.zeros(n, np.int64)
        x, y = ({*overlap._winnowed(s, np.array([n]), np.array([0]), row)[1].tolist()} for s in (a, b))
        assert x & y


def test_overlaps_with_even_changes_tabs_and_other_scripts(spark, members):
    given = entity_link.register_given(members)
    rows = []
    for i in range(100):
        w = [f"w{i}x{j}" for j in range(28)]
        v = [f"c{i}z{j}" if j in (5, 11, 17, 23) else x for j, x in enumerate(w)]
        rows += [(2 * i, "tr", "\t".join(w)), (2 * i + 1, "de", "\u00a0".join(v))]
    letters = "абвгдежзиклмнопрст"
    text = [a + b for a in letters for b in "аеио"][:40]
    rows += [(1000, "tr", " ".join(text)), (1001, "de", " ".join(text[:20] + ["другое"] + text[21:])), (1002, "tr", None), (1003, "de", "")]
    df = spark.createDataFrame(rows, "rec_id long, file string, text string")
    sp = spark.createDataFrame([("tr", "train"), ("de", "dev")], "file string, split_name string")
    got = {(r.rec_id_a, r.rec_id_b) for r in overlap.overlap_pairs(df, sp, given).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(100)} | {(1000, 1001)}


def test_chains_are_extended():
    a = np.arange(60)
    b = np.concatenate([a[:20], [900, 901], a[24:50], [902], a[50:]])
    assert overlap.chained(a, b) == [(0, 0, 20), (24, 22, 26), (50, 49, 10)]
    assert overlap.aligned(a, b, 50)[0] == overlap.common(a, b) == 56
    assert overlap.chained(a, a[::-1]) == [] and overlap.chained(a[:3], a) == []
    rng = np.random.default_rng(1)
    for _ in range(200):
        x, y = rng.integers(0, 30, 50), rng.integers(0, 30, 45)
        y[10:30] = x[5:25]
        got, inside = overlap.aligned(x, y, 1000)
        assert got == overlap.common(x, y) and inside <= got


def test_reading_of_lines():
    given = names.given_names(["Oliver Sintor Wernochum"])
    assert speech.split_label("[00:01:02] Mr. Speaker:- x", given)[:2] == ("office", "Mr. Speaker")
    assert speech.split_label("SPK_02: x")[0] == "voice" and speech.split_label("Several hon. Members - x")[0] == "group"
    assert speech.split_label("Let me repeat: x")[0] == "" and speech.split_label(None)[0] == "" and speech.split_label("")[0] == ""
    assert speech.spoken("(2.01 p.m.) I, um, said [Laughter] erm... so\n- 12 -\n*coughs* yes</b>") == "I, said so yes"
    assert speech.is_heading("<Header>Bills</Header>") and speech.is_heading("PAPERS LAID") and not speech.is_heading("PARLIAMENTARY DEBATES") and not speech.is_heading("[Prayers]") and not speech.is_heading(None)
    assert not speech.has_words("- 12 -") and not speech.has_words("(Applause)") and speech.has_words("No!") and not speech.has_words("")


def test_deficits_count_what_the_state_holds(spark):
    """A large file in train, then four small new ones: none of them may go to train; old files stay in the result."""
    state = splits.split_table(_records(spark, [[], [("Vol 5 No. 5", 600)]]))
    assert {r.split for r in state.collect()} == {"train"}
    got = splits.assign_splits(_records(spark, [[], [("vol_5_num_5.txt", 2)], [("Vol 6 No. 1", 10)], [("Vol 7 No. 1", 10)], [("Vol 8 No. 1", 10)], [("Vol 9 No. 1", 10)]]), state).collect()
    by = {r.file: r for r in got}
    assert len(by) == 6 and by["Vol 5 No. 5"].split == by["vol_5_num_5.txt"].split == "train"
    assert by["Vol 5 No. 5"].component == by["vol_5_num_5.txt"].component == state.first().component
    assert {r.split for f, r in by.items() if f[4] in "6789"} == {"dev", "test"}
