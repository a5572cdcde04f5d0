import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bindery.css import parser as css

TEXTS = [
    ("  .menu[open]   nav {\n}\n", ".menu[open] nav{}", 1),
    ("#top{ }\n\n.side { \n }", "#top{}.side{}", 2),
    ("td:last-child + td{}", "td:last-child+td{}", 1),
    ("ul > li.odd ~ li:not(.hidden )::after q:lang(fr){}", "ul>li.odd~li:not(.hidden)::after q:lang(fr){}", 1),
    (".hero{margin: -4px 12px;}", ".hero{margin:-4px 12px;}", 1),
    ("img{height:calc(50% + 2em);}", "img{height:calc(50%+2em);}", 1),
    ("p{*zoom:one;left:two\\9;top:three\\0/;clear:both!important;float:left !ie6;_right:four}", "p{*zoom:one;left:two\\9;top:three\\0/;clear:both!important;float:left!ie6;_right:four;}", 1),
    ("* html h1{k:v}*+html h2{k:v}", "* html h1{k:v;}*+html h2{k:v;}", 2),
    ("@media print{.note:focus{ink:none;}}", "@media print{.note:focus{ink:none;}}", 1),
    ("@import url(base.css);h3{}", "@import url(base.css);h3{}", 2),
    ("@-moz-document url(u){h4{k:v;}}", "@-moz-document url(u){h4{k:v;}}", 1),
    ("@page{margin:1cm;@top-left{content:none;}}", "@page{margin:1cm;@top-left{content:none;}}", 1),
]


@pytest.mark.parametrize("text, expected, n", TEXTS)
def test_render(text, expected, n):
    sheet = css.parse(text)
    assert (str(sheet), len(sheet.rules), sheet.errors) == (expected, n, [])
    assert str(css.parse(expected)) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("7em/pick(4,5)+8px*2.5+6*7", "7em/pick(4,5)+8px*2.5+6*7"),
        ("mix(red, dark blue )", "mix(red,dark blue)"),
        ("(1em+2px)*4", "(1em+2px)*4"),
        ("url(data:font/woff;base64,AbCd)", "url(data:font/woff;base64,AbCd)"),
        ("outer(inner(9),inner(8em))", "outer(inner(9),inner(8em))"),
        ("12/34 wide", "12/34 wide"),
        (".25", "0.25"),
    ],
)
def test_values(value, expected):
    sheet = css.parse("b{k:" + value + "}")
    assert str(sheet) == "b{k:" + expected + ";}" and not sheet.errors


def test_precedence():
    value = css.parse("b{k:7em/pick(4,5)+8px*2.5+6*7}").rules[0].properties[0].values[0]
    assert (value.name, str(value.values[0]), str(value.values[1])) == ("+", "7em/pick(4,5)", "8px*2.5+6*7")


SANITIZED = [
    ("#box{nonsense}", "#box{nonsense}", "#box{}", "#box{}", "#box{}"),
    ("#box{ink:#12345;garbage;size:;}", "#box{ink:#12345;garbage;size:;}", "#box{ink:#12345;size:;}", "#box{ink:#12345;size:;}", "#box{}"),
    (
        "h1{ink:#12345}}h2{ink:tan}}h3{top:0}{}",
        "h1{ink:#12345}}h2{ink:tan;}}h3{top:0;}{}",
        "h1{ink:#12345;}h2{ink:tan;}h3{top:0;}",
        "h1{ink:#12345;}h2{ink:tan;}h3{top:0;}",
        "h1{}h2{ink:tan;}h3{top:0;}",
    ),
    ("#box{50%{ink:tan}}", "#box{50%{ink:tan}}", "#box{}", "#box{}", "#box{}"),
]


@pytest.mark.parametrize("text, original, understood, no_errors, valid", SANITIZED)
def test_sanitize(text, original, understood, no_errors, valid):
    sheet = css.parse(text)
    assert [sheet.render(m) for m in (css.ORIGINAL, css.UNDERSTOOD, css.REMOVE_ERRORS, css.REMOVE_INVALID)] == [original, understood, no_errors, valid]
    assert sheet.errors or not sheet.is_valid


def test_comment_marks():
    sheet = css.parse("<!-- h5{ink:tan;} -->")
    assert sheet.render(css.ORIGINAL) == "<!-- h5{ink:tan;}-->"
    assert str(sheet) == "h5{ink:tan;}" and sheet.errors


@pytest.mark.parametrize(
    "text, kind, predicate, new, expected, n",
    [
        ("q:focus,s:focus{}u:focus{}", "simple_selector", ":focus", ".on", "q.on,s.on{}u.on{}", 3),
        ("q:focus,s:focus{}u:focus{}", "simple_selector", ":focus", None, "q,s{}u{}", 3),
        ("h6{fill: none url(old.svg)}", "function", "url(old.svg)", "url(new.svg)", "h6{fill:none url(new.svg);}", 1),
        ("ol{}dl#far{}", "class_rule", "dl#far{}", None, "ol{}", 1),
        ("ol{ink:tan;top:0;}dl#far{ink:sky;}", "property", "ink", None, "ol{top:0;}dl#far{}", 2),
        ("@media print{q:focus{ink:tan;}}", "simple_selector", ":focus", None, "@media print{q{ink:tan;}}", 1),
    ],
)
def test_find(text, kind, predicate, new, expected, n):
    sheet = css.parse(text)
    found = css.find(sheet, kind, lambda x: predicate in (str(x), x.name))
    for f in found:
        f.remove() if new is None else f.replace(new)
    assert (len(found), str(sheet)) == (n, expected)


def test_clone():
    sheet = css.parse("i:focus,j{k:v}l{}@media m{n:focus{}o{}}@font-face{p:q}r:not(:focus){}")
    assert str(css.clone(sheet)) == str(sheet)
    assert str(css.clone(sheet, lambda s: str(s) == ":focus")) == "i:focus{k:v;}@media m{n:focus{}}r:not(:focus){}"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.#:{};,()[]=@\"'/*->+ \n\\!%1", max_size=60))
def test_never_fails_and_settles(text):
    sheet = css.parse(text)
    for mode in (css.UNDERSTOOD, css.REMOVE_ERRORS, css.REMOVE_INVALID, css.ORIGINAL):
        sheet.render(mode)
    assert css.rows(text)[0][3] == "stylesheet"


names = st.text(alphabet="abcxyz", min_size=1, max_size=5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(names, st.dictionaries(names, st.sampled_from(["red", "1px", "#fff", "url(a.png)", "f(1,2)", "1px solid"]), max_size=3)), max_size=4))
def test_well_formed_sheets_round_trip(rules):
    text = str(css.stylesheet(*[css.rule("." + s, p) for s, p in rules]))
    sheet = css.parse(text)
    assert str(sheet) == text and not sheet.errors and sheet.is_valid
