"""Text, Markdown and key expressions."""

from colloquy.functions import text
from colloquy.functions.markdown import markdown_text, neutral_text

OPEN, CLOSE, SEP = "\ue200", "\ue201", "\ue202"


def test_markers(value):
    good = f"a{OPEN}cite{SEP}t{CLOSE}b{OPEN}navlist{SEP}x\ny{CLOSE}"
    kept = [
        f"{OPEN}other{SEP}x{CLOSE}", f"{OPEN}cite{SEP}open", f"{OPEN}cite{SEP}{CLOSE}",
        f"{OPEN}cite{SEP}{'é' * 8193}{CLOSE}", f"x{CLOSE}y{SEP}",
    ]
    nested = f"{OPEN}cite{SEP}a{OPEN}filecite{SEP}b{CLOSE}c"
    bounded = f"{OPEN}cite{SEP}{'é' * 8192}{CLOSE}"
    assert value(text.strip_markers, [good, *kept, nested, bounded, None]) == [
        "ab", *kept, f"{OPEN}cite{SEP}ac", "", None,
    ]


def test_byte_truncate(value):
    cases = ["short", "é" * 10, "aé" * 4, "界" * 5, "😀" * 3, None]
    want = ["short", "é" * 3, "aéaéa", "界界", "😀", None]
    assert value(lambda c: text.byte_truncate(c, 7), cases) == want


def test_file_names(value):
    cases = {
        "**Exceptional Opportunity Scan": "Exceptional-Opportunity-Scan.md",
        "../../Café — 安全/Quarter:Plan?.": "Café-安全-Quarter-Plan.md",
        '../\\:*?"<>|': "Untitled-conversation.md",
        "0123456789abcdef0123456789abcdef": "Untitled-conversation.md",
        "CON": "Conversation-CON.md",
        "com10": "com10.md",
        "界" * 100: "界" * 32 + ".md",
    }
    assert value(lambda c: text.export_file_name(c, "md"), list(cases)) == list(cases.values())


def test_controls(value):
    cases = ["a\x1bb\x07\rc\r\nd\te", "plain", "\x85\x00"]
    assert value(text.encode_controls, cases) == ["a[U+001B]b[U+0007]\nc\nd\te", "plain", "[U+0085][U+0000]"]


def test_display(value):
    assert value(text.display_title, ["  a \n\t b ", "\x00 ", "0123456789abcdef0123456789abcdef"]) == [
        "a b", "Untitled conversation", "Untitled conversation",
    ]
    assert value(text.display_role, ["USER", "tool", " ", "robot  x"]) == ["User", "Tool", "Other", "robot x"]


def test_seconds(value):
    assert value(lambda c: text.plain_seconds(c.cast("double")), ["1735689600", "0.5", "1e10", "0", "-3.25", None]) == [
        "1735689600", "0.5", "10000000000", "0", "-3.25", None,
    ]


def test_markdown_is_neutral(value):
    active = '<img src="x"> ![r](https://p) [d](https://q) \x1b]0;t\x07\rnext'
    code = "Use `v[0] < n && r` here.\n\n```rust\nif v[0] < n {\n}\n```\n\n<b>"
    odd = "```bad` info\n<i>\n~~~\n<kept>\n~~~~ \n<x> ``a` <y>``"
    got = value(markdown_text, [active, code, odd, "plain"])
    assert got[0] == '&lt;img src="x"&gt; !&#91;r&#93;(https://p) &#91;d&#93;(https://q) [U+001B]&#93;0;t[U+0007]\nnext'
    assert got[1] == code.replace("<b>", "&lt;b&gt;")
    assert got[2] == "```bad` info\n&lt;i&gt;\n~~~\n<kept>\n~~~~ \n&lt;x&gt; ``a` <y>``"
    assert got[3] == "plain"
    assert neutral_text("    ```\n<a>") == "    ```\n&lt;a&gt;"


def test_opaque_identifiers(value):
    cases = ["a" * 32, "A" * 40, "0" * 64, "01234567-89ab-cdef-0123-456789abcdef", "a" * 33, "g" * 32, "a" * 32 + "\n"]
    assert value(text.is_opaque_identifier, cases) == [True] * 4 + [False] * 3
