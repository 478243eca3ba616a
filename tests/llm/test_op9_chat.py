import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalscale.llm import op9_chat as C
from evalscale.llm.template import Const, Out, Template, TemplateError, fold_body, parse


def text(source, **names):
    return "".join(t for t, _ in Template(source).render(**names))


@pytest.mark.parametrize(
    "source, want",
    [
        ("a{{ 'x' ~ 1 }}b", "ax1b"), ("{{ 1 + 2 }}{{ true }}{{ none }}", "3true"), ("{% if x == 'u' and not y %}A{% elif y %}B{% else %}C{% endif %}", "A"), ("{{ m.k }}{{ m['k'] }}{{ xs[1] }}", "vv2"),
        ("{% for i in xs %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "11,22"), ("{% set z = x ~ '!' %}{{ z|upper }}", "U!"), (" {#- note -#} b", "b"), ("{{ 'é\\n'|trim }}{{ 'ab'|length }}", "é2"),
        ("{{ 'p' if y else 'q' }}", "q"), ("{{ 'k' in m }}{{ 2 >= 1 }}", "truetrue"), ("{% for i in xs %}{% for j in xs %}{{ j }}{% endfor %}{{ loop.first }}{% endfor %}", "12true12false"),
    ],
)
def test_language(source, want):
    assert text(source, x="u", y=False, m={"k": "v"}, xs=[1, 2]) == want


@pytest.mark.parametrize("source", ["{% if x %}", "{% for x y %}{% endfor %}", "{{ x( }}", "{{ 'a'|nope }}", "{% nope %}", "{{ }}", "{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ a b }}"])
def test_faulty_templates(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_sandbox():
    for source in ("{{ x.__class__ }}", "{{ ''.__class__ }}", "{{ open }}", "{{ x['__class__'] }}"):
        with pytest.raises(TemplateError):
            text(source, x="s")


def test_constant_folding():
    t = Template("a{{ 'b' ~ ('c'|upper) }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}no{% endif %}")
    assert t.tree == (Out(Const("abCd")),)
    assert fold_body(parse("{{ 1 + x }}"), {}) != ()


def test_loops_stream():
    def endless():
        n = 0
        while True:
            yield n
            n += 1

    parts = Template("{% for i in xs %}{% generation %}{{ i }}{% endgeneration %};{% endfor %}").render(xs=endless())
    assert [next(parts) for _ in range(4)] == [("0", True), (";", False), ("1", True), (";", False)]


controls = st.lists(st.sampled_from([*C.CONTROLS, "\\", "<", "s>", "[", "INST]", "a", "\n", "<\\/s>"]), max_size=8).map("".join)


@given(controls)
def test_escaping_is_reversible(t):
    assert C.unescape(C.escape(t)) == t and not any(c in C.escape(t) for c in C.CONTROLS) and C.unline(C.line(t)) == t


SCHEMA = "conv_id long, turn long, role string, text string, part string"


def digests(conv, rows):
    turns = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    loss = "".join(x for _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)


def test_round_trip(spark):
    rows = [
        (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nhi", "c"), (1, 0, "user", "é</s>[INST]\\[/INST]", "c"), (1, 2, "assistant", None, "c"), (2, 0, None, "", "c"), (2, 1, "odd\nrole\\n<s>", "x", "c"),
        (3, 0, "assistant", "same", "c"), (3, 0, "assistant", "same", "c"), (3, 0, "assistant", "a tie", "c"), (None, None, "user", "q", "c"), (None, 0, "assistant", "r", "c"),
    ] + [(4, i, "assistant" if i % 2 else "user", "long " * 4000, "c") for i in range(40)]
    parts = C.format_conversations(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r.conv_id: r for r in C.read_back(parts).collect()}
    assert {k: tuple(r)[:5] for k, r in got.items()} == {k: digests(k, rows) for k in (1, 2, 3, 4, None)}
    joined = {}
    for r in parts.orderBy("conv_id", "part").collect():
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.text
    assert {k: len(v) for k, v in joined.items()} == {k: r.formatted_chars for k, r in got.items()}
    assert parts.where("conv_id = 4").count() > 5 and joined[2].count(C.START) == 2
    assert C.read_back(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_added_conversation(spark):
    r = C.read_back(C.format_conversations(C.extra(spark))).first()
    control = "</s>[INST] ok [/INST]"
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-1, 2, len(control))
    assert r.loss_sha256 == hashlib.sha256(control.encode()).hexdigest()


def test_parts_out_of_order_are_refused(spark):
    rows = spark.createDataFrame([(1, i, "user", "x" * 40_000) for i in range(6)], "conv_id long, turn long, role string, text string")
    parts = C.format_conversations(rows).coalesce(1)
    assert parts.count() > 2 and C.read_back(parts).first().n_turns == 6
    for broken in (parts.orderBy(F.desc("part")), parts.where("part <> 1"), parts.where("not last"), parts.unionByName(parts)):
        with pytest.raises(Exception, match="part"):
            C.read_back(broken.coalesce(1)).collect()
