"""Column functions against small tables of cases."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import predicates, text
from lectern.operators import sittings, spans
from lectern.sources import tables

HEADERS = ["papers laid", "bills"]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_clean_text(spark):
    assert column(spark, [" a \t b ", "):) x", "(", "", None, "a\nb"], text.clean_text) == ["a b", " x", "", "", None, "a\nb"]


def test_punctuation(spark):
    assert column(spark, ["'two words'", "-x y;", "!?", "q[r]", "{q", "", None], text.rm_wrapping_punct) == ["two words", "x y", "", "q[r]", "{q", "", None]
    assert column(spark, ["a.b,c!", None], text.rm_punct) == ["abc", None]
    assert column(spark, ["-", "", "- a", "...", None], text.is_punct) == [True, True, False, True, None]


def test_ascii_fold(spark):
    got = column(spark, ["Mürenbe ½ ﬁsh", "plain", "议", None, "İı"], text.ascii_fold)
    assert got[0] == "Murenbe 12 fish" and got[1] == "plain" and got[2] == "" and got[3] is None
    exact = column(spark, ["Mürenbe ½ ﬁsh", None], text.ascii_fold_exact)
    assert exact == ["Murenbe 12 fish", None]


@pytest.mark.parametrize(("s", "clean", "names"), [
    ("<header>A</header>", "A", ["header"]), ("<newspeech>Mr. X", "Mr. X", ["newspeech"]), ("<New-Speech> x</new speech>", " x", ["newspeech"]), ("header> x", " x", ["header"]),
    ("<b>x</b>", "x", ["b"]), ("no tags", "no tags", []), ("<scene>(x)</scene><b>y", "(x)y", ["b", "scene"]), ("<subheader>x", "x", ["subheader"]),
])
def test_tags(spark, s, clean, names):
    assert column(spark, [s], text.strip_tags) == [clean]
    assert column(spark, [s], text.tags) == [names]


def test_page_predicates(spark):
    assert column(spark, ["12", "12345", "1a", "", None], predicates.is_page_number) == [True, False, False, False, False]
    assert column(spark, ["PARLIAMENTARY DEBATES", "PARLIMENTARY DEBATE", "Parliamentary Debates"], predicates.is_page_heading) == [True, True, False]
    dates = ["Tuesday, 12", "March, 12", "Tuesday, 14th March, 2001", "th", "hello", "March 3, 2001 and more", "x" * 80 + " Tuesday, 12", None]
    assert column(spark, dates, predicates.is_page_date) == [True, True, True, True, False, True, False, False]
    assert column(spark, ["NATIONAL ASSEMBLY", " OFFICIAL REPORT ", "", None, "x"], predicates.is_transcript_heading) == [True, True, False, False, False]


def test_rule_label(spark):
    lines = ["12", "-", "Papers Laid", "THE FINANCE BILL", "Clause 3", "(Applause)", "I said so.", "ALL CAPS ENDS.", "", None, "n e w c l a u s e 3", "Head 12", "Question No. 3"]
    want = ["garbage", "punct", "header", "subheader", "subsubheader", "scene", "speech", None, "garbage", "garbage", "subsubheader", "subsubheader", "subheader"]
    assert column(spark, lines, lambda c: predicates.rule_label(c, HEADERS)) == want


@pytest.mark.parametrize(("raw", "title", "name", "appt"), [
    ("Zelfanten", None, "Zelfanten", None), ("  Dr. Ada Quillim", "Dr", "Ada Quillim", None), ("Prof.Quillim", "Prof", "Quillim", None), ("Dr. (Hon.) Vuntamor", "Dr Hon", "Vuntamor", None),
    ("Minister for Lakes (Dr. Quillim)", "Dr", "Quillim", "Minister for Lakes"), ("Dr. Quillim (Minister for Lakes)", "Dr", "Quillim", "Minister for Lakes"),
    ("The Deputy Speaker", None, None, "The Deputy Speaker"), ("The Deputy Speaker (Dr. Vuntamor)", "Dr", "Vuntamor", "The Deputy Speaker"),
    ("Dr. Q.V. Orrim (Lower Plain, ABC/D)", "Dr", "Q.V. Orrim", "Lower Plain, ABC/D"), ("(Orrim)", None, "Orrim", None), ("five/six members", None, None, "five/six members"), ("#", None, None, None), ("", None, None, None), (None, None, None, None),
])
def test_parse_speaker(spark, raw, title, name, appt):
    r = column(spark, [raw], spans.parse_speaker)[0]
    assert (r.title, r.name, r.appointment) == (title, name, appt)


def test_bio_round_trip(spark):
    rows = [(10, 2, 5), (4, 0, 4), (3, None, None), (3, 2, 2), (0, None, None)]
    df = spark.createDataFrame(rows, "n int, s int, e int").withColumn("bio", text.span2bio(F.col("n"), F.col("s"), F.col("e")))
    got = df.withColumn("b", text.bio2span(F.col("bio"))).collect()
    assert [r.bio for r in got] == ["OOBIIOOOOO", "BIII", "OOO", "OOO", ""]
    assert [(r.b.start, r.b.end) for r in got] == [(2, 5), (0, 4), (None, None), (None, None), (None, None)]


def test_header_words(spark):
    d = {"of", "and", "note", "the", "plan"}
    cases = {
        "l akes of t he plan": "lakes of the plan", "f i rst plan": "fi rst plan", "a note": "a note", "a quarry": "aquarry", "the a broad plan": "the abroad plan", "the l aw a": "the lawa", "note a": "note a",
        "traders ' s note": "traders's note", "q ' sk een": "q's keen", "part - 3": "part-3", "( note ) and [ plan ]": "(note) and [plan]", "no.7 and 4.50": "no. 7 and 4. 50", "x) note": "x) note", " note  of ": "note of", "": "", None: None,
    }
    assert dict(zip(cases, column(spark, list(cases), lambda c: text.fix_header_words(c, d)))) == cases


def test_legacy_parse(spark):
    cases = {
        "Dr. Quillim": ("quillim", "dr", None), "Dr. Quillim (The Minister for Lakes)": (None, None, "the minister for lakes"), "The Minister for Lakes (Dr. Quillim)": ("quillim", "dr", "the minister for lakes"),
        "An Hon. Member": ("member", "an hon", None), "(Rtd Maj. Orrim)": ("maj orrim", "rtd", None), "Engineer Orrim": ("orrim", "engineer", None), "Bishop Orrim": ("bishop orrim", None, None), "Several Members": (None, None, "several members"), None: (None, None, None),
    }
    assert {k: tuple(v) for k, v in zip(cases, column(spark, list(cases), spans.legacy_parse))} == cases


def test_intermediate_results_need_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://x:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="shared|share"):
        tables.shared_dir(Session())


def test_sitting_times(spark):
    docs = ["x\nTuesday, 14th March, 2001\nThe House met at 2.30 p.m.\n" + "y " * 200 + "\nThe House rose at 6.15 p.m.", "no date", "31st February, 1999", "", None, "MARCH 3, 1988 the house met at 12.05 a.m."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {r.doc: (str(r.start_date), str(r.end_date)) for r in sittings.sitting_meta(df).collect()}
    assert got[0] == ("2001-03-14 14:30:00", "2001-03-14 18:15:00")
    assert got[1] == got[2] == got[3] == got[4] == ("None", "None")
    assert got[5] == ("1988-03-03 12:05:00", "None")


def test_header_words_have_even_blanks(spark):
    rng = random.Random(4)
    rows = ["".join(rng.choices("ab '-.()[]a", k=rng.randint(0, 30))) for _ in range(300)]
    assert not [x for x in column(spark, rows, text.fix_header_words) if "  " in x]
