"""Files that are broken or refused, HTML by its tags, repair in one pass, and the drawing of questions."""

import re

import pytest
from pyspark.sql import functions as F

from hybridrank import sources as S
from hybridrank.operators import reports as X

LONG = "and this is a paragraph that is long enough to be a document"


def test_every_file_is_a_document_or_has_a_reason(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    for name, data in {"a.txt": LONG.encode(), "deep/b.md": b"# Head\n\n" + LONG.encode(), "short.txt": b"too little", "empty.html": b"", "x.pdf": b"%PDF" + LONG.encode(), "noend": LONG.encode(), "bad.TXT": b"\xff\xfe " + LONG.encode()}.items():
        (tmp_path / "in" / name).write_bytes(data)
    scanned = S.scanned_files(spark, str(tmp_path / "in")).cache()
    assert {r.doc_id for r in scanned.where("reason IS NULL").collect()} == {"a", "deep/b", "bad"}
    assert {r.path.rsplit("/in/")[1]: r.reason for r in S.refused(scanned).collect()} == {"short.txt": S.TOO_SHORT, "x.pdf": S.UNSUPPORTED, "noend": S.UNSUPPORTED}
    assert {r.doc_id: r.source for r in S.read_files(spark, str(tmp_path / "in")).collect()} == {"a": "a", "deep/b": "Head", "bad": "bad"}
    assert S.read_files(spark, str(tmp_path / "in"), recursive=False).count() == 2


@pytest.mark.parametrize(
    "html, title, text",
    [
        ("<title>T &amp; U</title><p>a&nbsp;b &eacute;&#233;&#x1F600;</p>", "T & U", "T & U\na\xa0b éé\U0001f600"),
        ("<div><nav>menu <div>deep</div></nav>x<header>h<nav>n</nav>more</header>y</div>", "", "x\ny"),
        ("<div><nav>never closed <p>still</div><p>after", "", "after"),
        ("<p>one<br>two<img src='a>b'>three</p></nav></p>four", "", "one\ntwo\nthree\nfour"),
        ("<script>if (a < b) { '</p>' }</script>x<!-- <p>not</p> -->y<style>p{}</style>", "", "x\ny"),
        ("<title>first</title><svg><title>second</title></svg>", "first", "first\nsecond"),
        ("a <b>bold</b> c < d", "", "a\nbold\nc < d"),
        ("<TITLE>\n Big \n one </TITLE><FOOTER>f</FOOTER>", "Big one", "Big \n one"),
        ("", "", ""),
        (None, None, None),
        ("<p><p><p>" * 50000 + "end", "", "end"),
        ("&nosuchname; &copy &lt;p&gt; <3", "", "&nosuchname; © <p> <3"),
    ],
)
def test_html_by_its_tags(html, title, text):
    assert S._parsed(html) == (title, text)


def test_html_files_go_through_the_parser(spark, tmp_path):
    (tmp_path / "p.html").write_text(f"<html><head><title>A &copy; B</title><script>var x = '<p>no</p>';</script></head><body><nav><ul><li>menu</nav><p>{LONG} &mdash; &#8364;5</p></body>")
    (row,) = S.read_files(spark, str(tmp_path)).collect()
    assert row.source == "A © B" and "— €5" in row.text and "menu" not in row.text and "var" not in row.text


def reference_repair(text, vocabulary):
    """The stated rule, pair after pair from left to right."""
    low = lambda t: t.replace("İ", "i").replace("I", "ı").lower()
    join = lambda m: m[1] + m[2] if low(m[1] + m[2]) in vocabulary and low(m[2]) not in vocabulary else m[0]
    return re.sub(r"\b([a-zçğıöşü]{3,})\s([a-zçğıöşü]{1,3})\b", join, text, flags=re.IGNORECASE)


def test_repair_in_one_pass(spark):
    texts = [
        "yönetmeliği yönetmeliği YÖNETMELİĞİ kapılar kapılar kapılarda kapılarda",
        "yönetmeli ği yönetmeli ği, yönetmeli ği. Yönetmeli ği",
        "kapı lar da kapı lar da",  # joined once; its end begins no other pair
        "éyönetmeli ği yönetmeli ğié x_kapı lar kapı lar_x",
        "kapı\nlar kapı\tlar kapı  lar",
        "YÖNETMELİ Ğİ KAPI LAR",
        "",
        None,
        "kapı lar " * 3000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = S.vocabulary(docs.limit(1))
    words = {r.term for r in known.collect()}
    got = {r.doc_id: r.text for r in S.repair_word_breaks(docs, known).collect()}
    assert got == {i: None if t is None else reference_repair(t, words) for i, t in enumerate(texts)}
    assert {(r.head, r.tail): r.n for r in S.word_breaks(docs.where("doc_id = 2"), known).collect()} == {("kapı", "lar"): 2}
    assert S.repair_word_breaks(docs, known.limit(0)).where("doc_id = 1").first().text == texts[1]


def passages(spark, n=40):
    rows = [(i, f"s{i % 3}", f"[[page:{i}]] " + f"passage {i} about subject{i} " * 20 if i % 10 else "short") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_questions_are_drawn_until_there_are_enough(spark):
    asked = []

    def generate(good):
        def run(rows):
            ids = [r.doc_id for r in rows.collect()]
            asked.extend(ids)
            return rows.select("doc_id", F.when(F.expr(good), F.concat(F.lit("1. What does subject"), F.col("doc_id").cast("string"), F.lit(" mean to you?\nThat is it."))).otherwise("no question").alias("raw"))

        return run

    got = X.generated_questions(passages(spark), generate("true"), 6).orderBy("position").collect()
    assert len(got) == len(asked) == 6 and [r.position for r in got] == list(range(6)) and [r.attempt for r in got] == list(range(1, 7))
    assert got[0].question == f"What does subject{got[0].gold[0]} mean to you?" and not got[0].gold_answer.startswith("[[") and 0 < got[0].gold_overlap < 1
    again = X.generated_questions(passages(spark).repartition(7), generate("true"), 6).orderBy("position").collect()
    assert [r.gold for r in again] == [r.gold for r in got]
    # Replies that are no use are made up for, in the same order of the draw.
    asked.clear()
    some = X.generated_questions(passages(spark), generate("doc_id % 2 = 0"), 6).orderBy("position").collect()
    assert len(some) == 6 and all(r.gold[0] % 2 == 0 for r in some) and len(asked) <= 15
    # Never more attempts than the cap, however bad the model is.
    asked.clear()
    assert X.generated_questions(passages(spark), generate("false"), 6).count() == 0 and len(asked) == 15
    asked.clear()
    assert X.generated_questions(passages(spark), generate("false"), 6, factor=100).count() == 0 and len(asked) == 36
    same = lambda rows: rows.select("doc_id", F.lit("Is this always the same question?").alias("raw"))
    assert [r.attempt for r in X.generated_questions(passages(spark), same, 6).collect()] == [1]
    assert X.generated_questions(passages(spark), lambda rows: rows.select("doc_id", F.lit(None).cast("string").alias("raw")).limit(3), 6).count() == 0
    with pytest.raises(ValueError):
        X.generated_questions(passages(spark).where("doc_id = 0"), generate("true"), 6)


def test_referential_phrases(spark):
    rows = spark.createDataFrame([(t,) for t in ("Bu maddede hangi kural vardır?", "bu bölümde ne yazıyor acaba?", "Metinde geçen süre nedir acaba?", "What does the passage tell us?", "Başvuru süresi kaç gündür?")], "t string")
    usable = lambda phrases: [r.u for r in rows.select(X.is_usable_question(F.col("t"), phrases).alias("u")).collect()]
    assert usable(X.REFERENTIAL) == [False, False, False, True, True]
    assert usable(X.MORE_REFERENTIAL) == [False, False, False, False, True]
