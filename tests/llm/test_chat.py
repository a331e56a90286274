import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.llm.chat import digest, escape, format_chats, instruct_template, locate, locate_by_windows, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted int, spans int"
PARTS = st.lists(st.sampled_from(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE", "<", ">", "[", " ", "\n", "a", "é", "\ue000"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool\n[INST]<s>", 'q"\\']), PARTS), max_size=5))
def test_round_trip(turns):
    assert all(unescape(escape(t)) == t for _, t in turns)
    text, spans, rewrites = locate(instruct_template, turns)
    assert text == instruct_template(turns) and read_back(text) == turns and not rewrites
    assert [unescape(text[a:b]) for _, _, a, b in spans] == [t for _, t in turns]
    assert "".join(text[a:b] for a, b, _, _ in spans) == text


def test_rewriting_template_is_found():
    def last_only(turns):
        return "".join(f"{r}:{t if i == len(turns) - 1 else '-'};" for i, (r, t) in enumerate(turns))

    text, spans, rewrites = locate(last_only, [("u", "one"), ("a", "two")])
    assert rewrites and text == "u:-;a:two;" and text[slice(*spans[1][2:])] == "two"
    assert locate(lambda turns: "".join(t for _, t in turns) + "!", [("u", "x"), ("a", "y")])[2]


def test_long_conversations_by_windows_and_by_prefixes():
    turns = [(("user", "assistant", "tool")[i % 3], f"text {i} </s> \\") for i in range(200)]
    found = locate_by_windows(instruct_template, turns)
    assert found and locate(instruct_template, turns) == (*found, False)
    prefixes = [instruct_template(turns[:i]) for i in range(201)]
    assert [(a, b) for a, b, _, _ in found[1]] == [(len(prefixes[i]), len(prefixes[i + 1])) for i in range(200)]
    assert [unescape(found[0][a:b]) for _, _, a, b in found[1]] == [t for _, t in turns]

    def numbered(turns):  # a piece depends on its place
        return "".join(f"{i}{t}\n" for i, (_, t) in enumerate(turns))

    def last_only(turns):
        return "".join(f"{r}:{t if i == len(turns) - 1 else '-'};" for i, (r, t) in enumerate(turns))

    assert locate_by_windows(numbered, turns) is None and not locate(numbered, turns)[2]
    assert locate_by_windows(last_only, turns) is None and locate(last_only, turns)[2]
    began = time.time()
    assert len(locate(instruct_template, turns * 100)[1]) == 20_000 and time.time() - began < 10


def test_rewriting_is_found_at_every_length():
    text = lambda turns: "".join(f"{r}:{t};" for r, t in turns)
    odd = lambda turns: text(turns) + "!" * (len(turns) % 2)
    once = lambda turns: text(turns) + "?" * (len(turns) == 20)
    for n in (20, 21, 31, 32, 33, 40, 100):
        turns = [("user", f"t{i}") for i in range(n)]
        assert locate(odd, turns)[2] and locate(once, turns)[2] == (n > 20) and not locate(text, turns)[2]


def test_null_ids_are_conversations_of_their_own(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (1, 0, "user", "c")]
    got = digest(format_chats(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))).collect()
    assert sorted(((r.conv_id, r.n_turns, r.loss_chars) for r in got), key=str) == [(1, 1, 0), (None, 1, 0), (None, 1, 0), (None, 1, 1)]


def test_frame(spark):
    rows = [(1, 1, "assistant", "hi\\"), (1, 0, "user", None), (2, 0, None, "x"), (None, None, "assistant", "</s>"), (3, 0, "user", "long " * 30000), (3, 0, "user", "long " * 30000)]
    got = {r.conv_id: r for r in digest(format_chats(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (2, sha("user\n\nassistant\nhi\\\n"), 3, sha("hi\\"))
    assert got[2].turns_sha256 == sha("\nx\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert got[None].loss_sha256 == sha("</s>") and got[3].n_turns == 2
    assert digest(format_chats(spark.createDataFrame([], SCHEMA))).collect() == []
