import duckdb
import pytest

from tidemark.llm import html, language, preferences, quality, urls


def by_duckdb(sql, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toPandas() if hasattr(df, "toPandas") else df)
    r = con.sql(sql)
    return sorted(r.columns), sorted(tuple(row[r.columns.index(c)] for c in sorted(r.columns)) for row in r.fetchall())


def of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(r[c] for c in names) for r in df.collect())


def test_quality_equals_sql(docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    want, got = by_duckdb(quality.SQL, documents=plain), of(quality.quality_rules(plain))
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert all(g == pytest.approx(w, abs=2e-6) for g, w in zip(got[1], want[1]))


def test_repeated_words_and_guards(spark):
    text = "a b c d e f a b c d e"
    df = spark.createDataFrame([(1, text, "en"), (2, None, None), (3, "x y", "en"), (3, "x y", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert got[1].n_repeat_words == 10 and got[1].base_failed and not got[1].kept
    assert got[2].n_words == 0 and got[2].base_failed
    assert quality.quality_rules(df).count() == 4


def test_native_operators_run_no_python(docs, spark):
    turns = spark.createDataFrame([(0, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    for df in (quality.features(docs), preferences.conversation_preferences(turns)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_url_rules(spark):
    pages = [(1, "https://A.Example.NET/en/x?q#f"), (2, "http://b.net/y"), (3, "http://example.com/de/1"), (4, "http://x.org/fr/2"), (5, "http://net"), (6, None), (7, "nothing"), (7, "nothing"), (8, "http://notexample.net.com/en/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(5, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, labels).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[5][:3] == ("net", "", None) and got[6][:3] == ("", "", None) and got[7][:2] == ("", "")
    assert urls.judge_urls(df, labels).count() == len(pages)
    assert urls.judge_urls(df.limit(0), labels).count() == 0 and urls.judge_urls(df, labels.limit(0)).count() == len(pages)


def test_hosts_with_many_bad_pages_are_blocked(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 2}.com/{i}") for i in range(400)]
    labels = [(i, 0 if i % 2 else 1, 0) for i in range(400)]
    df, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = urls.judge_urls(df, lab)
    assert {(r.host, r.verdict) for r in got.collect()} == {("bad.site1.com", "block"), ("good.site0.com", "allow")}
    want = by_duckdb(urls.SQL, pages=df, labels=lab)
    assert of(got) == want or [tuple("" if v is None else str(v) for v in r) for r in of(got)[1]] == [tuple("" if v is None or v != v else str(v) for v in r) for r in want[1]]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/x>Home</a></nav><div class="ad">the best of the best</div>
<article><h1>A  title &amp; more</h1><p>Short.<p>The house of the river and the garden is in the light of the morning, &eacute;t&#233; and <b>bold</b><br>text with a <a href=y>link</a> in it.</p>
<div class="comments"><p>nice one, the first of the day and of the week</p></div><form><input>Send</form></article><aside>See also</aside><footer>&copy; us</footer></body>"""


def test_main_text():
    assert html.main_text(PAGE) == "A title & more\nShort.\nThe house of the river and the garden is in the light of the morning, été and bold text with a link in it."


def test_pages_without_article_go_by_density():
    long = "The house of the river and the garden is in the light of the morning and of the day. " * 4
    page = f"<body><div>Menu</div><p>{long}</p><p>Short bit.</p><p>{long}</p><p><a href=x>{long}</a></p></body>"
    assert html.main_text(page).split("\n") == [long.strip(), "Short bit.", long.strip()]
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""


@pytest.mark.parametrize("before, after", [('<body class="has-header-image has-sidebar">', ""), ('<body class="right-sidebar">', ""), ('<html class="no-cookie"><body>', ""), ('<div id="content" class="with-sidebar">', "</div>"), ('<div class="layout sidebar-right">', "</div>")])
def test_layout_names_drop_no_article(before, after):
    text = "The house of the river and the garden is in the light of the morning and of the day."
    page = f'{before}<div class="sidebar">{text}</div><article class="post no-comments"><p>{text}</p><div class="comments"><article class="comment"><p>{text} No.</p></article></div></article>{after}'
    assert html.main_text(page) == text


LINE = "The house of the river and the garden is in the light of the morning and of the day."
FIELDS = "<label>Name</label><input><select><option>One</option></select><button>Send</button>"


@pytest.mark.parametrize(
    "inner",
    [f"<article><p>{LINE}</p><p>Short.</p></article>", f"<main><p>{LINE}</p><p>Short.</p></main>", f"<main><article><p>{LINE}</p><p>Short.</p></article></main>", f"<div><p>{LINE * 3}</p><p>Short.</p><p>{LINE * 3}</p></div>"],
)
@pytest.mark.parametrize("around", ["<form id=page>%s</form>", "<div role=dialog>%s</div>", "<div role=form><form>%s</form></div>", "<main><form>%s</form></main>", "<dialog open>%s</dialog>"])
def test_forms_and_dialogs_around_the_page(around, inner):
    page = f"<body><nav>Home Shop</nav>{around % (FIELDS + inner)}<form class=x>{FIELDS}<p>Leave a reply.</p></form><footer>us</footer></body>"
    got = html.main_text(page).split("\n")
    assert got[-1] in ("Short.", LINE * 3) and LINE in got[-2 if "Short" in got[-1] else -1] and "Short." in got
    assert not {"Send", "One", "Leave a reply.", "Home Shop", "us"} & set(got)


def test_forms_beside_the_article_go():
    ask = "By sending this form you agree to the rules of the house and of the garden and of the river."
    page = f"<body><article><p>{LINE}</p><p>{LINE}</p></article><form><p>{ask}</p>{FIELDS}</form><div role=alert><p>{ask}</p></div></body>"
    assert html.main_text(page).split("\n") == [LINE] * 2
    assert html.main_text(f"<body><form>{FIELDS}<p>Leave a reply.</p></form></body>") == ""
    inside = f"<body><form><article><p>{LINE}</p><form><p>Reply</p></form><div class=comments><p>{LINE}</p></div></article></form></body>"
    assert html.main_text(inside) == LINE


def test_links_around_blocks():
    teaser = f"<a href=x><div><h3>More</h3><p>{LINE * 3}</p></div></a>"
    page = f"<body><p>{LINE * 3}</p>{teaser}{teaser}<p>{LINE * 3}</p></body>"
    assert html.main_text(page).split("\n") == [LINE * 3] * 2
    unclosed = f"<body><div><a href=x>Home</div><p>{LINE * 3}</p><a name=here><p>{LINE * 3}</p></body>"
    assert html.main_text(unclosed).split("\n")[-2:] == [LINE * 3] * 2


def test_pages_of_short_blocks_stay():
    page = "<body><nav>Home</nav><p>One of the three.</p><p>And two.</p><div><a href=x>Elsewhere on this site</a></div><p>The third.</p></body>"
    assert html.main_text(page).split("\n") == ["One of the three.", "And two.", "The third."]


def test_article_text_with_links_and_fallbacks():
    text = "The house of the river and the garden is in the light of the morning and of the day."
    linked = f"<a href=x>{text}</a>"
    page = f"<article><h2><a href=x>{text}</a></h2><p>{text}</p><p>{linked}</p><p>{text} {linked[:60]}</a></p><p>{text} <math><mi>x</mi></math> <object data=y>fallback</object></p><ul><li>{linked}</li><li>{linked}</li></ul></article>"
    got = html.main_text(page).split("\n")
    assert got[:3] == [text] * 3 and got[4] == f"{text} x fallback" and len(got) == 5


def test_languages_without_a_list_go_by_length_and_links():
    text = "Дом у реки стоит в саду, и утром свет падает на старые камни возле воды. " * 4
    page = f"<body><div>Меню</div><p>{text}</p><p><a href=x>{text}</a></p><p>{text}</p></body>"
    assert html.main_text(page).split("\n") == [text.strip()] * 2


def test_pages_keep_every_row(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "", 7)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id or 0, r.n_chars == len(r.text)) for r in html.extract_pages(df).collect()) == [(0, True), (1, True), (1, True), (2, True)]


def test_language_on_held_out_rows(spark):
    parts = {"en": "the of and ing tion whe tha ere".split(), "de": "der die und sch ung keit ein ver".split(), "fr": "le la et eau oux ment que tion".split()}
    import random

    rnd = random.Random(3)
    rows = [(i, " ".join("".join(rnd.choices(parts[l], k=2)) for _ in range(40)), l) for i in range(600) for l in [rnd.choice(list(parts))]]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score")
    got = {r.doc_id: r for r in language.identify_languages(df).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002)) and got[1003].lang_pred == rows[0][2]
    held = [r for r in rows if r[2] and r[1] and r[0] < 1000 and got[r[0]].held_out]
    assert len(held) > 100 and sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.97
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_rare_languages_are_learned(spark):
    """Eighty languages, of which the last sixteen are rarer than the others."""
    import random

    rnd = random.Random(11)
    parts = [["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(8)] for _ in range(80)]
    rows = [(0, " ".join("".join(rnd.choices(parts[k], k=2)) for _ in range(30)), f"l{k:02}") for k in range(80) for _ in range(14 if k < 64 else 8)]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = language.identify_languages(df).join(df, "doc_id").collect()
    assert {r.lang_pred for r in got} == {f"l{k:02}" for k in range(80)}
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97


def test_language_without_labels(nothing, docs):
    assert language.identify_languages(nothing).count() == 0
    assert {r.lang_pred for r in language.identify_languages(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_preferences_equal_sql(spark):
    turns = [(0, 0, "system", "be kind"), (0, 1, "user", "hi"), (0, 2, "assistant", "yo"), (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello é"), (1, 3, "user", "and?"), (1, 4, "assistant", "bye"), (2, 0, "user", None), (2, 1, "assistant", ""), (5, 0, "user", "alone"), (6, 0, "user", "same"), (7, 0, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS pair_id")
    got = {r.pair_id: r for r in preferences.conversation_preferences(df).collect()}
    r = got["n0"]
    assert r.n_common == 2 and r.prompt == "<|system|>\nbe kind\n<|user|>\nhi\n" and r.chosen == "<|assistant|>\nyo\n"
    a, b = map(int, r.chosen_mask.split("-"))
    assert r.chosen[a:b] == "yo\n" and got["n3"].chosen == got["n3"].rejected == "" and got["n3"].n_common == 1
    assert got["s1"].n_common == 4 and got["s1"].rejected == "<|assistant|>\nhello é\n" and got["n2"].chosen == ""
    assert of(preferences.conversation_preferences(df)) == by_duckdb(preferences.SQL, conversations=df.drop("pair_id"))
    assert preferences.conversation_preferences(df.limit(0)).count() == 0
