import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.functions import config, options, text
from folioforge.operators import books, media, providers, requests, runs
from folioforge.operators import sentences as S
from folioforge.sources import artifacts, epub, pdf, wav


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "expected", "merges"),
    [
        ("E\nVERY MOMENT IN BUSINESS MATTERS.", "EVERY MOMENT IN BUSINESS MATTERS.", 1),
        ("E\n\nVERY MOMENT IN BUSINESS MATTERS.", "EVERY MOMENT IN BUSINESS MATTERS.", 1),
        ("A\nCHAPTER ONE", "A\nCHAPTER ONE", 0),
        ("1.\nA\nALPHA item", "1.\nA\nALPHA item", 0),
        ("A\n\n\nBCDE far below here", "A\n\n\nBCDE far below here", 0),
        ("", "", 0),
    ],
)
def test_drop_caps(spark, given, expected, merges):
    r = one(spark, text.merge_drop_caps, given)
    assert (r["text"], r["merges"]) == (expected, merges)


def test_cleaning(spark):
    assert one(spark, text.blank_page_numbers, "a\n 12 \nb") == "a\nb" or one(spark, text.blank_page_numbers, "a\n 12 \nb").split() == ["a", "b"]
    assert one(spark, text.join_hyphens, "exam-\nple, é-\nà") == "example, éà"
    assert one(spark, text.plain_quotes, "“it’s” ‘x") == "\"it's\" ‘x"
    assert one(spark, text.collapse_blanks, "a \t b \nc") == "a b\nc"
    assert one(spark, text.drop_figure_refs, "see [Fig. 3] and [figure 12]!") == "see  and !"
    assert one(spark, lambda t: text.slug(t), "Český název: Úvod!") == "cesky-nazev-uvod"
    assert one(spark, lambda t: text.reader_token(t), "Český název") == "esk-n-zev"
    assert one(spark, text.latin1, "a\tb c…é") == "a    b c?é"
    assert one(spark, lambda t: text.part_id(F.lit(1), F.lit(1), t), "  ") == "001_01_chapter-001"


def test_html_and_xhtml_agree(spark):
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>';</script></head><body><h1>A &amp; B</h1><p>x<br/>y</p><!-- gone --><ul><li>1</li><li>2</li></ul></body></html>"
    assert one(spark, text.html_to_text, page) == epub.xhtml_text(page) == "T\nA & B\n\nx\n\ny\n\n1\n\n2"


def test_references_cut_before_their_semicolon(spark):
    page = "<html><body><h1>a &amp;&amp;&amp</h1><p>b &quot</p><p>c &am</p></body></html>"
    assert one(spark, text.html_to_text, page) == epub.xhtml_text(page) == 'a &&&\n\nb "\n\nc &am'


def test_entities_titles_and_slugs_of_any_script(spark):
    page = "<title>T</title><body>Hello &eacute; &#233; &#xe9; &hellip; a&nbsp;b<tbody>x</tbody>"
    assert one(spark, text.html_to_text, page) == epub.xhtml_text(page) == "THello é é é … a\u00a0b\nx"
    assert one(spark, lambda t: text.slug(t), "Cafő łódź ﬁn") == "cafo-odz-fin"
    assert one(spark, options.stem_title, "it's_3rd-book") == "It'S 3Rd Book" and one(spark, options.stem_title, "_-") == "Translated Document"


def test_what_a_cut_sentence_is():
    cut = S._is_cut_sentence
    for head in ("word", ", so", "; so", ": so", ") so", "(so", "[so", "{so", "«so", "“so", '"so', "'so"):
        assert cut("it goes", head) and not cut("it ends.", head), head
    for head in ("Word", "‘so", "(So", "", "  "):
        assert not cut("it goes", head), head
    assert not cut('He said it. ) "', "so") and cut('an "open quote', "Word") and not cut("", "Word")


def test_headings_and_marks(spark):
    df = spark.createDataFrame([(1, "Chapter 1–Foo\nx"), (2, "a \ue000 b\nChapter 2 - Two\nc \ue000\ue001 d\ue002"), (3, "Chapter\n5\nx")], "book_id long, text string")
    rows = sorted((r["book_id"], r["chapter_index"], r["title"], r["text"]) for r in books.split_chapters(df).collect())
    assert rows == [(1, 1, "Chapter 1", "Chapter 1–Foo\nx"), (2, 1, "Chapter 1", "a \ue000 b"), (2, 2, "Chapter 2 - Two", "c \ue000\ue001 d\ue002"), (3, 1, "Chapter 5", "x")]
    units = spark.createDataFrame([(1, 1, "lost\n1.2.3 Deep\nSection 4\nbody")], "book_id long, chapter_index long, text string")
    assert [(r["title"], r["text"]) for r in books.split_subchapters(units).orderBy("subchapter_index").collect()] == [("1.2.3 Deep", "1.2.3 Deep"), ("Section 4", "body")]


def test_a_line_that_begins_with_dotted_numbers_is_a_subheading(spark):
    """Wherever it comes from: a document's own line cuts as one that was put around it."""
    doc = "First.\n28.68.191.238 Den zu.\nLast."
    made = spark.createDataFrame([(1, 1, f"lost\n1.1 part\n{doc}\n1.2 part\n{doc}")], "book_id long, chapter_index long, text string")
    got = [(r["title"], r["text"]) for r in books.split_subchapters(made).orderBy("subchapter_index").collect()]
    own = ("28.68.191.238 Den zu.", "Last.")
    assert got == [("1.1 part", "First."), own, ("1.2 part", "First."), own]


def test_custom_rules_and_anchored_paths(spark):
    assert one(spark, lambda t: text.clean(t, [text.plain_quotes]), " “a” \n 12 ") == '"a" \n 12'
    assert one(spark, text.keep_headers, "Header\nx") == "Header\nx"
    there = lambda path: path == "/run/audio/a.wav"
    assert [config.anchored(x, "/run/manifest.json", "/d", there) for x in ("/abs", "audio/a.wav", "other.wav", " ", None, 3)] == ["/abs", "/run/audio/a.wav", "other.wav", "/d", "/d", "/d"]


def test_chapters(spark):
    df = spark.createDataFrame([(1, "CHAPTER 1\nAlpha line.\n\nCHAPTER 2: Beta\nBeta line.\n"), (2, "no heading"), (3, "  "), (4, "Before\nKapitola IV\n"), (5, "Chapter One\nx")], "book_id long, text string")
    rows = sorted((r["book_id"], r["chapter_index"], r["title"], r["text"]) for r in books.split_chapters(df).collect())
    assert rows == [
        (1, 1, "CHAPTER 1", "Alpha line."),
        (1, 2, "CHAPTER 2: Beta", "Beta line."),
        (2, 1, "Chapter 1", "no heading"),
        (4, 1, "Chapter 1", "Before"),
        (4, 2, "Kapitola IV", "Kapitola IV"),
        (5, 1, "Chapter 1", "Chapter One\nx"),
    ]


def test_chunks():
    cut = lambda t, n: [(t[a:b], how) for a, b, how in S.chunks(t, n)]
    assert cut("One short sentence. Another one! Final question?", 24)[0] == ("One short sentence. ", S.COMPLETE)
    assert cut("x" * 25 + ". Tail sentence.", 20)[0][0] == "x" * 25 + ". "
    assert cut("Dr. Smith measured 3.14 units today. He documented results.", 28)[0][0].endswith("today. ")
    assert [len(t) for t, _ in cut("abcdef", 3)] == [3, 3] or cut("abcdef", 3)
    assert S.chunks("abc", 0) == [] and S.chunks("", 5) == []
    for n in (3, 10, 50):
        text = "He said e.g. this, etc. and U.S.A. things. Then 3.14! \"Why?\" no. 5 " * 9
        parts = S.chunks(text, n)
        assert "".join(text[a:b] for a, b, _ in parts) == text and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))


def test_plans():
    paragraphs = "\n\n".join(c * 2000 for c in "ABC")
    assert [len(p[2]) for p in S.plan([(1, 1, "t", paragraphs)], 4500)] == [4002, 2000]
    assert S.plan([(1, 1, "", "Alpha"), (2, 1, "", "Beta"), (3, 2, "", "Gamma")], 100) == [(1, 0, "Alpha\n\nBeta", [1, 2]), (2, 0, "Gamma", [3])]
    assert S.plan([(1, 7, "", "  ")], 100) == [(7, 0, "Chapter 7", [1])]
    assert max(len(p[2]) for p in S.plan([(k, 1, "", "w" * 4000) for k in range(6)], 10_000)) <= S.CEILING


def test_repair():
    left, right = 'He asked this question: "What', 'important truth about markets?" Then he paused.'
    pieces, n = S.repair([(left, 0, len(left), S.COMPLETE), (right, len(left), len(left) + len(right), S.COMPLETE)], 60)
    assert n == 1 and pieces[0][0] == left + 'important truth about markets?" ' and pieces[1][0] == "Then he paused."
    assert pieces[0][2] == pieces[1][1] and pieces[0][3] == S.REPAIRED


def test_cache_keys_and_provider(spark):
    df = spark.createDataFrame([(1, "Hello   world"), (2, "Hello world"), (3, "other")], "doc_id long, text string")
    got = {r["doc_id"]: r["answer"] for r in providers.call_provider(df, "mock", "cs").collect()}
    assert got == {1: "[cs] Hello   world", 2: "[cs] Hello   world", 3: "[cs] other"}
    t = requests.telemetry(df).first()
    assert (t["requests"], t["misses"], t["hits"], t["hit_rate"]) == (3, 2, 1, "0.3333")
    with pytest.raises(ValueError):
        providers.call_provider(df, "nobody", "cs")


def test_limiter_and_retries():
    waits = []
    limiter = providers.Limiter(0.5, clock=lambda: 0.0, sleep=waits.append)
    limiter.wait(), limiter.wait()
    assert waits == [0.5]
    tried, slept = [], []

    def call():
        tried.append(1)
        if len(tried) < 3:
            raise providers.ProviderError("timeout")
        return "ok"

    assert providers.with_retries(call, sleep=slept.append) == ("ok", 2) and slept == [0.5, 1.0]
    with pytest.raises(providers.ProviderError):
        providers.with_retries(lambda: (_ for _ in ()).throw(providers.ProviderError("invalid_credentials")), sleep=slept.append)


def test_selections(spark):
    df = spark.createDataFrame([(x,) for x in ("1,3", "2-4", "", "1,1", "4-2", "9")], "selection string")
    got = {r["selection"]: (r["indices_csv"], r["valid"]) for r in runs.parse_selections(df, available=5).collect()}
    assert got == {"1,3": ("1,3", True), "2-4": ("2,3,4", True), "": ("1,2,3,4,5", True), "1,1": (None, False), "4-2": (None, False), "9": (None, False)}


def test_samples(spark):
    df = spark.createDataFrame([([0, 5, -900, 3, 0],), ([0, 1],)], "s array<long>")
    rows = df.select(media.trim_silence(F.col("s"), 4).alias("t"), media.normalize(F.col("s"), 1800).alias("n"), media.peak(F.col("s")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [([5, -900], [0, 10, -1800, 6, 0], 900), ([], [0, 1800], 1)]


def test_epub_round_trip(spark, tmp_path):
    made = spark.createDataFrame([(1, "Book & Co", "Ann", "en", "abc", [("One <1>", "First.\n\nSecond & last."), ("Two", "Third.")])], "book_id long, title string, author string, language string, identifier string, chapters array<struct<title: string, text: string>>")
    rows = epub.build_epubs(made).withColumn("name", F.lit("b.epub"))
    assert artifacts.write_files(rows, f"file://{tmp_path}", name_col="name", content_col="content") == 1
    got = sorted((r["chapter_index"], r["book_title"], r["author"], r["title"], r["text"]) for r in epub.read_epubs(spark, str(tmp_path)).collect())
    assert [g[:4] for g in got] == [(1, "Book & Co", "Ann", "One <1>"), (2, "Book & Co", "Ann", "Two")]
    assert got[0][4].endswith("First.\n\nSecond & last.")
    content = (tmp_path / "b.epub").read_bytes()
    assert zipfile.ZipFile(io.BytesIO(content)).infolist()[0].filename == "mimetype"
    assert content == epub.build("Book & Co", "Ann", "en", "abc", [("One <1>", "First.\n\nSecond & last."), ("Two", "Third.")])
    assert epub.resolve("OEBPS/nav.xhtml", "../../x") is None and epub.resolve("OEBPS/nav.xhtml", "t/a%20b.xhtml#f") == "OEBPS/t/a b.xhtml"


def test_epub_without_navigation():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o.opf"/></rootfiles></container>')
        z.writestr("o.opf", '<package><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.css" media-type="text/css"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="missing"/></spine></package>')
        z.writestr("a.xhtml", "<html><body><p>Only text</p></body></html>")
    package = epub.parse(out.getvalue())
    assert package.nav is None and epub.chapters_of(package) == [("Chapter 1", "Only text")]


def test_wav(spark):
    a, b = wav.make(struct.pack("<3h", 1, -2, 3)), wav.make(struct.pack("<2h", 4, 5))
    df = spark.createDataFrame([(1, 2, bytearray(b)), (1, 1, bytearray(a))], "book_id long, part long, wav binary")
    merged = bytes(wav.merged(df, "book_id", ["part"]).first()["wav"])
    assert wav.samples(wav.describe(merged)[3], 2).tolist() == [1, -2, 3, 4, 5] and wav.duration(merged) == 5 / 24000
    tagged = wav.tagged(wav.tagged(a, {"INAM": "old"}), {"INAM": "new", "IART": "x"})
    assert [d for n, d in wav.parts(tagged) if n == b"LIST"] == [b"INFOIART\x02\x00\x00\x00x\x00INAM\x04\x00\x00\x00new\x00"]
    assert wav.samples(b"\x00\x80\xff", 1).tolist() == [-128, 0, 127]
    assert wav.samples(b"\xff\xff\xff\x01\x00\x00", 3).tolist() == [-1, 1] and wav.samples(b"\xfe\xff\xff\xff", 4).tolist() == [-2]


def test_artifacts(spark, tmp_path):
    chapters = spark.createDataFrame([("b", 1, "t", "é")], "book_id string, index int, title string, text string")
    artifacts.write_artifact(chapters, "chapters", f"{tmp_path}/c")
    assert artifacts.read_artifact(spark, "chapters", f"{tmp_path}/c").collect() == chapters.collect()
    (tmp_path / "bad.json").write_text('{"book_id": "b", "index": 1, "title": null, "text": "x"}\n')
    with pytest.raises(Exception, match="title"):
        artifacts.read_artifact(spark, "chapters", f"{tmp_path}/bad.json").collect()


def test_pdf():
    made = pdf.build("Ti(tle", [("One", "word " * 3000 + "\n\nend €")])
    assert made.startswith(b"%PDF-1.4") and made.count(b"/Type /Page ") > 3 and b"Ti\\(tle" in made and b"end ?" in made
    assert pdf.wrap("aa bb " + "c" * 30, 12 * 11 * 0.56, 11) == ["aa bb", "c" * 12, "c" * 12, "c" * 6]
    assert made == pdf.build("Ti(tle", [("One", "word " * 3000 + "\n\nend €")])


def test_config():
    got = config.from_mapping(config.parse_yaml("# c\ninput_path: 'a.pdf'\nchunk_size_chars: 900 # n\nrewrite_bypass: yes\nextra:\n  k: v\n"))
    assert (got["input_path"], got["chunk_size_chars"], got["rewrite_bypass"], got["extra"]) == ("a.pdf", 900, True, {"k": "v"})
    for bad in ({"input_path": "x", "wrong": 1}, {}, {"input_path": "x", "chunk_size_chars": 0}, {"input_path": "x", "rewrite_bypass": "maybe"}):
        with pytest.raises(ValueError):
            config.from_mapping(bad)
    assert config.from_env({"FOLIOFORGE_INPUT_PATH": " b.epub ", "OTHER": "1"})["input_path"] == "b.epub"
    assert config.resolve("k", {"k": " "}, {"k": " env "}, {"k": "default"}) == "env"
    assert config.run_id({"a": 1, "b": "é"}) == config.run_id({"b": "é", "a": 1})
