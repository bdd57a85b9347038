import time

from paperloom.llm.markup import convert, first_pass, languages, second_pass, strip_markup

COMMON = frozenset(["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "was", "on"])

FOUND = {
    "html": ["<b class='x'>bold</b>", "a &nbsp; b", "x<br/>y", "&#8211;", "<td>4</td>"],
    "markdown": ["**bold** text", "# Head", "see [this](a.html)", "![fig](x.png)", "use `code` here", "~~no~~", "__in__", "| a | b |\n|---|---|\n| 1 | 2 |", "[text][ref1]", "```python\nx\n```", "an ***all*** of"],
    "wiki": ["[[Link|text]]", "{{cite|A|1990}}", "''it''", "'''b'''", "== Head ==", '{| class="wikitable"\n|-\n| a || b\n|}'],
    "latex": [r"\textbf{x}", r"$O(n \log n)$", r"\[ x \]", r"\"{o}", r"\begin{itemize}", "so $x_{5}$ holds", r"\item one"],
}
PLAIN = [
    "with p < 0.05 and n > 40 it is", "The R&D staff", "between $12 and $30 per item", "3 * 4 * k counts", "max_step_size and use_cache", "a ~ b and x^2 + y^2 = 1", "sends [0, 1] to {a, b}",
    "problem #3 in the list", "as in [12] and [3, 4]", "f(x) = g(x) | x", "1. Introduction", "- a dash\n- another", "run-7/out_file.dat", "it's John's", "f''(x) and g''(x)", "",
]


def test_each_language_for_its_own():
    for name, texts in FOUND.items():
        for t in texts:
            assert languages(t) == [name], (name, t, languages(t))


def test_ordinary_characters_are_no_markup():
    for t in PLAIN:
        assert languages(t) == [], t
        assert convert(t, COMMON)[0] == []


def test_structure_stays():
    clean = lambda t: convert(t, COMMON)[1]
    assert clean("<h2>A head</h2><ul><li>one</li><li>two</li></ul>") == "## A head\n\n- one\n\n- two"
    assert clean("x <pre><code>for i in y:\n    f(i)</code></pre>").endswith("```\nfor i in y:\n    f(i)\n```")
    assert "4.1 | 7" in clean("<table><tr><td>4.1</td><td>7</td></tr></table>")
    assert clean(r"\section{Name}" + "\n" + r"\begin{itemize}" + "\n" + r"\item one" + "\n" + r"\end{itemize}") == "# Name\n\n- one"
    assert "$O(n)$" in clean(r"It is $O(n)$ with \emph{care} in the end of it.")
    assert "$$ x + 1 $$" in clean(r"\[ x + 1 \]")
    assert clean(r"M\"{o}bius is the name of it.") == "Möbius is the name of it."
    assert "a | b" in clean('{| class="wikitable"\n|-\n| a || b\n|}')
    assert clean("[[Graph theory|graphs]] and ''more'' of the same.") == "graphs and more of the same."


def test_two_passes():
    assert second_pass(["good", "short", "short", "bad"]) == ["good", "good", "bad", "bad"]
    assert second_pass(["bad", "short", "bad"]) == ["bad", "bad", "bad"]
    assert second_pass(["short", "short"]) == ["good", "good"]
    assert second_pass([]) == []
    assert first_pass("text", "the of and " * 30, COMMON) == "good"
    assert first_pass("text", "\ue002" + "links " * 30 + "\ue003", COMMON) == "bad"
    assert first_pass("text", "short one", COMMON) == "short"


def test_texts_without_links_are_kept_whole():
    texts = {
        "list": ["• sparse topology discretisations\n• parallel inversion orbits\n• theoretical field curvatures", "(i) dense electrons\n(ii) generic exciton registers\n(iii) phase amplifiers, which wrap\nto a second line", "[1] Quill, Abstract stability: a careful exciton, Invented Annals 1 (2001) 347\n[2] Fenn, Network operator, Annals 37 (2007) 452", "enzyme diffusion, 279, 379\nplasma kernel sheaf, 98, 253\nmonsoon basin, 384-386"],
        "table": ["calibration,benchmark,glacier,halo\nrun0,3360,1330,3508\nrun2,0.19,89.9%,1126\nrun3,12,7,9", "mutation\tdiffusion\tcovariance\n0\t2272\t4.89\nrun1\t6.26\t87.2%", "detector    attractor    telescope\nrun0    2701    0.36\nreceiver    1126    2613", "1 22 3.5 7\n2 31 4.5 9\n3 17 5.5 8\n4 12 6.25 9 11\n5 31 33 35 37 39 41 43 45"],
        "text": ["kvd zmvxh lqrh gdtm xdrtcs kdjl qxzsw gjj knpsfn nncs jhsrq\nbckmg cmnj vbpdh lwnfd qffk qxjjd"],
    }
    for kind, each in texts.items():
        for t in each:
            for whole in (t, t + "\n\nA short line"):
                found, clean, blocks = convert(whole, COMMON)
                assert (found, clean, blocks[0]["kind"]) == ([], whole, kind), (whole, blocks)
    prose = "However, in the case of A, we have seen B, C, and the rest\nof it, which is (as in\n[1] and others) well known to everyone,  and so it was."
    assert convert(prose, COMMON)[2][0]["kind"] == "text"


def test_few_common_words_go_only_among_links():
    links = "".join(f'<a href="x">Some page {i}</a> ' for i in range(20))
    german = "Der untere Teil beschreibt, wie jede Messung am selben Ort wiederholt wurde und welche Werte dabei herauskamen."
    around = lambda t: convert(f"<p>{links}</p>\n\n<p>{t}</p>\n\n<p>{links}</p>", COMMON)[1]
    assert around(german) == german and around("Skip main content jump navigation search contents random article donate create account") == ""


def test_rows(spark):
    rows = [("a", "<b>x</b> and **y**"), ("a", "<b>x</b> and **y**"), ("n", None), ("e", ""), (None, "''w''"), ("long", "plain words of the text. " * 20_000)]
    df = spark.createDataFrame([(k, t, 1, "c") for k, t in rows], "paper_id string, clean_text string, markup int, blocks string")
    out = strip_markup(df, "clean_text", "paper_id", "clean_text", COMMON).collect()
    assert len(out) == len(rows)
    by = {r["item_key"]: r for r in out}
    assert by["a"]["markup"] == ["html", "markdown"] and by["n"]["clean_text"] is None and by["e"]["clean_text"] == "" and by[None]["markup"] == ["wiki"]
    assert strip_markup(df.limit(0), "clean_text", "paper_id", "clean_text", COMMON).count() == 0


def test_languages_come_from_the_blocks():
    long = "x + " * 900 + "y"
    texts = {
        "Plain words $" + long + "$ in a sentence.": ["latex"],
        "A box {{infobox|" + "a long value " * 300 + "}} in words.": ["wiki"],
        "<p>One.</p>\n\n## Two\n\nThree \\emph{four} and '''five'''.": ["html", "markdown", "wiki", "latex"],
        "It costs $5 here\n\nand there 10$ again.": [],
        "<br>": ["html"],
        "| a | b |\n|---|---|\n| 1 | 2 |": ["markdown"],
    }
    for text, want in texts.items():
        found, clean, blocks = convert(text, frozenset(["the", "in"]))
        assert found == want, text[:60]
        assert sorted(found) == sorted({n for b in blocks for n in b["markup"]})
        assert not any("" <= c <= "" for c in clean)
    _, _, blocks = convert("First part.\n\n<b>Second</b> part.", frozenset())
    assert [b["markup"] for b in blocks] == [[], ["html"]]


def test_elements_left_open_stay_linear():
    began = time.time()
    convert("<tr><td>cell <h2>head <a href='x'>link \\[ x <pre>code " * 4000, frozenset())
    assert time.time() - began < 20
