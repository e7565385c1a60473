from __future__ import annotations

import time
from collections import Counter

import pytest

from factloom.llm.spam_pages import Group, is_spam, line_shape, shape_groups, spam_pages

WORDS = ["blue pump", "cheap blue pump", "blue pump online", "pump coupon", "best blue pump", "pump near me"]
PROSE = "The pump keeps a handle to the valve after the screen is gone, so nothing is freed. We moved it behind an interface last week. "
SPAM = {
    "commas": ", ".join(WORDS * 8),
    "dots": " • ".join(WORDS * 8),
    "marks": "!!! ".join(w.upper() for w in WORDS * 8),
    "lines": "\n".join(WORDS * 8),
    "bullets": "/*\n * " + "\n * ".join(", ".join(WORDS) for _ in range(6)) + "\n */",
    "bare run": " ".join(WORDS * 8),
    "tags": " ".join("#" + w.title().replace(" ", "") for w in WORDS * 5),
    "links": "\n".join(f"[{w}](https://a-{i}.example/p/q-{i}.html)" for i, w in enumerate(WORDS * 4)),
    "hosts": "\n".join(f"{i}. Blue Pump - www.pump-{i}.example" for i in range(1, 30)),
    "anchors": " ".join(f'<a href="https://x-{i}.example/a">{w}</a>' for i, w in enumerate(WORDS * 4)),
    "goods": "\n".join(f"BluePump Kit {i % 3} | SKU {10000 + i} | USD {i}.99 | -53%" for i in range(20)),
    "meta": '<meta name="keywords" content="' + ", ".join(WORDS * 8) + '">\n<h1>pump</h1>',
    "said": "Buy blue pump today and get blue pump, because blue pump beats every other blue pump. " * 8,
    "japanese": "、".join(["格安 ポンプ", "ポンプ 通販", "青い ポンプ", "ポンプ 割引"] * 10),
    "mostly": PROSE + "\n" + ", ".join(WORDS * 12),
}
FINE = {
    "prose": PROSE * 6,
    "short tags beside prose": PROSE * 6 + "\ntags: " + ", ".join(WORDS),
    "links with sentences": "\n".join(f"- [Pump {i}](https://a-{i}.example/x): The fix is safe to apply unless the part belongs to a public signature number {i}." for i in range(12)),
    "code": "\n".join(f"    val pump{i} = openPump({i}) // blue pump\n    check(pump{i}.blue)" for i in range(30)),
    "log": "\n".join(f"00077{i:04} INFO  [pool-{i % 4}] waiting for blue-pump" for i in range(60)),
    "report": "\n".join(f"core/src/main/Pump.kt:{i}:9: warning: 'pump' is written but never read [StalePump]" for i in range(40)),
    "imports": "\n".join(f"import dev.blue.pump.Pump{i}" for i in range(40)),
    "imports in capitals": "\n".join(f"IMPORT DEV.BLUE.PUMP.VALVEHANDLER{'ABCDEFGHIJ'[i % 10]}" for i in range(40)),
    "trace": "\n".join(f"\tat dev.blue.Pump{i}.open(Valve.kt:{i})" for i in range(40)),
    "config": "pump:\n" + "\n".join(f"  rule-{i}:\n    active: true\n    limit: {i}" for i in range(30)),
    "xml": "\n".join(f'<string name="pump_{i}">Blue pump</string>' for i in range(30)),
    "few words": "same here",
    "see also": PROSE * 2 + "\nSee also:\n" + "\n".join(f"- [Pump{i}](https://a.example/{i})" for i in range(5)),
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert is_spam(SPAM[name])


@pytest.mark.parametrize("name", FINE)
def test_no_spam(name):
    assert not is_spam(FINE[name])


@pytest.mark.parametrize("text", [None, "", " \n\t", "\x00", "\x1b[31m\x1b[0m", "a" * 200_000, "#", "[", "<a", "| | |\n" * 500])
def test_odd_texts_are_no_cases(text):
    assert not is_spam(text)


DENSE = {
    "urls of one line": " ".join(f"https://a-{i}.example/p/{i}" for i in range(100)),
    "urls of eleven lines": "\n".join(" ".join(f"https://a-{i}-{j}.example/p" for j in range(10)) for i in range(11)),
    "hosts of one line": " ".join(f"pump-{i}.example" for i in range(100)),
    "hosts between commas": ", ".join(f"pump-{i}.example" for i in range(100)),
    "goods of three lines": "\n".join(f"BluePump Kit {i} | SKU {10000 + i} | USD {i}.99 | -53% | NEW" for i in range(3)),
}


@pytest.mark.parametrize("name", DENSE)
def test_items_count_however_lines_are_cut(name):
    assert is_spam(DENSE[name])


@pytest.mark.parametrize("text", [PROSE * 6 + "See pump.example and valve.example. ", "a.bb." * 60_000 + "1", "a-b." * 60_000])
def test_hosts_in_long_lines_are_no_cases(text):
    assert not is_spam(text)


def test_a_list_of_names_does_not_repeat_and_only_that_saves_it():
    names = "\n".join(f"{a} {b}" for a, b in zip("Ada Bo Cy Di Ed Flo Gus Hal Ivy Jo Kit Lou Mo Nan Ole Pat".split(), "Ash Birch Cedar Dill Elm Fir Gum Hazel Iris Jute Kelp Lime Maple Nut Oak Pine".split()))
    assert not is_spam(names) and is_spam(names, distinct=1.0)


def test_many_shapes_with_few_items_each_are_no_case_and_only_that_saves_them():
    # The same words in lines of ever other length and capitals, as in verse, menus and forms.
    words = "pump valve".split()
    lines = [f(" ".join((words * 4)[: n])) for n in (1, 2, 3, 4, 5, 6, 7) for f in (str.lower, str.upper, str.title)]
    assert not is_spam("\n".join(lines)) and is_spam("\n".join(lines), spread=0)
    assert is_spam("\n".join(lines * 8))


@pytest.mark.parametrize("text", ["[" * 200_000, "<a " * 100_000, "[a](" * 60_000, "<a href>" * 40_000, '<meta content="' * 30_000])
def test_broken_markup_takes_no_longer_than_its_length(text):
    began = time.monotonic()
    is_spam(text)
    assert time.monotonic() - began < 5


def test_anchor_texts_and_hosts_of_any_length():
    long = "blue pump " * 40
    assert line_shape(f"[{long}](https://a.example/x)")[0] == "links"
    assert shape_groups("\n".join(["blue pump"] * 3)) == {("short", 2, "l"): Group("short", 27, 3, Counter(blue=3, pump=3))}


def test_shapes_join_lines_of_one_make():
    a, b = (line_shape(f"{w} Kit | SKU {n} | $9.99 | NEW")[1] for w, n in (("Blue", 1), ("Green", 22)))
    assert a == b and a[0] == "goods"


def test_rows(spark, rows):
    data = [(1, SPAM["commas"]), (2, FINE["prose"]), (3, SPAM["commas"]), (3, SPAM["commas"]), (4, None), (None, SPAM["links"])]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id bigint, text string, shape string")
    assert rows(spam_pages(df)) == [(1,), (3,), (3,), (None,)]
    assert spam_pages(df.limit(0)).count() == 0
    assert spam_pages(df).columns == ["doc_id"]
