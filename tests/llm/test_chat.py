import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pointloom.llm import chat as C

hard = st.text(alphabet=st.sampled_from(list("<|\\>turnsayend \nAé")), max_size=30)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", ""]), hard), max_size=6))
def test_round_trip_and_spans(turns):
    out, spans = C.locate(C.render, turns)
    assert out == C.render(turns) and C.read_back(out) == turns
    assert [C.unescape(out[s.text_start : s.text_end]) for s in spans] == [t for _, t in turns]


def test_templates_that_rewrite_history():
    last_only = lambda turns: f"{len(turns)} turns: " + "".join(f"[{t}]" for _, t in turns)
    with pytest.raises(C.RewritesHistory):
        C.locate(last_only, [("user", "a"), ("assistant", "b")])
    upper = lambda turns: "".join(f"{r}:{t}\n" if i else f"{r}>>{t}\n" for i, (r, t) in enumerate(turns))
    out, spans = C.locate(upper, [("user", "a"), ("assistant", "b")])
    assert [out[s.text_start : s.text_end] for s in spans] == ["a", "b"]


def expected(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(told), len(said), sha(said), len(C.render([(r or "", t or "") for r, t in turns]))


def test_conversations(spark):
    rows = [(1, 1, "assistant", "é</s>[INST] <|end|>\\"), (1, 0, "user", "hi"), (2, 0, "user", None), (2, 0, None, "x"), (None, 3, "assistant", "n")]
    rows += [(3, i, "assistant" if i % 2 else "user", "long text " * (i % 50)) for i in range(3_000)]
    rows += [(4, 0, "user", "same")] * 2 + [(5, 0, "assistant", "y" * 500_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in C.format_conversations(df).collect()}
    assert len(got) == 6
    for k, r in got.items():
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))
        assert tuple(r)[1:6] == expected([x[2:] for x in own]) and not r.rewrites_history
    marked = C.format_conversations(df.where("conv_id = 1"), lambda t: f"{len(t)}" + C.render(t), lambda s: C.read_back(s[1:])).first()
    assert marked.rewrites_history and marked.loss_chars == 0 and marked.n_turns == 2
    assert C.format_conversations(df.limit(0)).count() == 0
    out = C.texts(df.where("conv_id = 1")).first()
    s = out.spans[1]
    assert C.unescape(out.formatted[s.text_start : s.text_end]) == rows[0][3]


def states(turns, template, unrender=C.read_back):
    return next(iter(C.formatted([(7, *t) for t in turns], template, unrender)))


def test_long_conversations_are_rendered_as_a_whole():
    turns = [("assistant" if i % 2 else "user", f"turn {i} " + "x" * 900) for i in range(300)]

    def forgets(shown):  # drops the reasoning of turns far back: seen only across the whole conversation
        return "".join(C.concatenate([(r, t[:9] if len(shown) - i > 200 else t)]) for i, (r, t) in enumerate(shown))

    assert states(turns, forgets).rewrites and states(turns, forgets).loss_chars == 0
    assert not states(turns[:150], forgets).rewrites
    opened = lambda shown: "<s>" + C.concatenate(shown)
    one = states(turns, opened, lambda s: C.read_back(s[3:]))
    near = states(turns, C.Local(opened), lambda s: C.read_back(s))
    plain, local = states(turns, C.concatenate), states(turns, C.render)
    assert one.chars == near.chars == plain.chars + 3 and plain.chars == local.chars == len(C.concatenate(turns))
    assert len({(x.n, x.turns.hexdigest(), x.loss.hexdigest(), x.loss_chars) for x in (one, near, plain, local)}) == 1


def test_a_template_that_remembers_more_than_it_states():
    def marks_change(shown):
        return "".join(("~" if i and shown[i - 1][0] == r else "") + C.concatenate([(r, t)]) for i, (r, t) in enumerate(shown))

    turns = [("user", "a"), ("user", "b"), ("assistant", "c")]
    read = lambda s: C.read_back(s.lstrip("~"))
    with pytest.raises(ValueError, match="remembers more"):
        states(turns, C.Local(marks_change), read)
    held = states(turns, C.Local(marks_change, 1), read)
    assert held.chars == len(marks_change(turns)) and held.loss_chars == 1 and not held.rewrites
