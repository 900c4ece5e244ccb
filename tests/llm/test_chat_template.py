import pytest
from hypothesis import given, settings, strategies as st

from arborlake.llm.chat_template import _MARK, CONTROLS, TEMPLATE, TemplateError, compile_template, escaper, fold, parse, read_back, read_conversations, format_conversations, unescape, FILTERS, Output, Const

HARD = st.text(st.sampled_from(["<", "/", "s", ">", "[", "]", "I", "N", "S", "T", "\\", "é", "\n", "x"]), max_size=12) | st.sampled_from([*CONTROLS, "\\", "</s", "[/INST"])
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "[INST]", "a\\"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, st.lists(HARD, max_size=4).map("".join)), max_size=6))
def test_round_trip(turns):
    text, spans = compile_template(TEMPLATE, CONTROLS)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert read_back(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@settings(max_examples=300, deadline=None)
@given(st.lists(HARD, max_size=6).map("".join))
def test_escaped_text_holds_no_control(text):
    escaped = escaper(CONTROLS)(text)
    assert unescape(escaped) == text
    # read from the left, as the output is read back, every mark is an escape
    assert all(m[0][0] == "\\" for m in _MARK.finditer(escaped))
    # whatever follows, no control string begins in the text and ends behind it
    for control in CONTROLS:
        joined = [m for m in _MARK.finditer(escaped + control) if m[0][0] != "\\"]
        assert [(m.start(), m[0]) for m in joined] == [(len(escaped), control)]


def test_plain_text_is_left_alone():
    assert escaper(CONTROLS)("a < b [x] {y} <sup>") == "a < b [x] {y} <sup>"


@pytest.mark.parametrize("source,variables,want", [
    ("a{# no #}b", {}, "ab"),
    ("{{ 'x' ~ 1 ~ true ~ none }}", {}, "x1true"),
    ("{{ 1 + 2 - 4 }}", {}, "-1"),
    ("{% if a == 'b' and not c %}yes{% elif c %}c{% else %}no{% endif %}", {"a": "b"}, "yes"),
    ("{% if a == 'b' and not c %}yes{% elif c %}c{% else %}no{% endif %}", {"a": "b", "c": 1}, "c"),
    ("{% for m in ms %}{{ loop.index0 }}{{ m['k'] | upper | trim }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": [{"k": " a "}, {"k": "b"}]}, "0A,1B"),
    ("{% set n = ms | length %}{{ n }}", {"ms": [1, 2, 3]}, "3"),
    ("{{ ms[0] }}{{ ms[9] }}{{ ms.x }}{{ nothing.at.all }}", {"ms": ["q"]}, "q"),
    ("{{ 'a\\n\\'b\\'' }}", {}, "a\n'b'"),
    ("{{ (a or b) and 'c' }}", {"b": 1}, "c"),
])
def test_language(source, variables, want):
    assert compile_template(source)(variables)[0] == want


@pytest.mark.parametrize("source", [
    "{% if a %}", "{% endfor %}", "{% for x of y %}{% endfor %}", "{{ a | evil }}", "{{ a b }}", "{{ }}", "{{ f(1) }}", "{% import os %}", "{{ 'a' + 1 }}", "{{ a ? b }}", "{% else %}"])
def test_errors(source):
    with pytest.raises(TemplateError):
        compile_template(source)({})


def test_sandbox():
    for source in ("{{ a.__class__ }}", "{{ a['__class__'] }}", "{{ a.x }}", "{{ a[0] }}"):
        assert compile_template(source)({"a": "text"})[0] == ""
    with pytest.raises(TemplateError):
        compile_template("{% for x in a %}{% endfor %}")({"a": "text"})


def test_folding():
    tree = fold(parse("a{{ 'b' ~ 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}{{ y }}{% endif %}e"), FILTERS)
    assert tree == (Output(Const("abCde")),)


def test_template_that_could_complete_a_control():
    with pytest.raises(TemplateError):
        compile_template("</{{ m | escape }}", CONTROLS)


def test_generation_spans():
    assert compile_template("{% generation %}ab{% endgeneration %}c{% generation %}{{ x }}{% endgeneration %}")({"x": "éé"}) == ("abcéé", [(0, 2), (3, 5)])


def test_edge_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, None, "x"), (2, 0, "user", ""),
            (None, 0, "user", "n"), (3, 5, "assistant", "é" * 100_000), (3, 4, "tool", "</s>")]
    turns = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, t string, turns string")
    back = {r["conv_id"]: r for r in read_conversations(format_conversations(turns)).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert back[1]["loss_text"] == "aab"
    assert [tuple(t) for t in back[2]["turns"]] == [("", "x"), ("user", "")]
    assert [tuple(t) for t in back[None]["turns"]] == [("user", "n")]
    assert back[3]["loss_text"] == "é" * 100_000
    assert format_conversations(turns.limit(0)).count() == 0
