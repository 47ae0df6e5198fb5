"""Line formats: Java properties, XUL entity files, message catalogues and Windows resources.

Values are escaped for XML; skeletons keep keys, comments and quotes. Unlike other imports of these formats a '>' becomes
'&gt;' (not '&lt;'), and a catalogue entry ends where the next begins, blank line or not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..schema import Parts, tokenise

# Keywords of resource statements that are followed by a text.
RC_KEYWORDS = (
    "AUTO3STATE", "AUTOCHECKBOX", "AUTORADIOBUTTON", "CAPTION", "CHECKBOX", "CONTROL", "CTEXT", "DEFPUSHBUTTON", "GROUPBOX", "LTEXT",
    "MENUITEM", "POPUP", "PUSHBOX", "PUSHBUTTON", "RADIOBUTTON", "RTEXT", "SCROLLBAR", "STATE3",
)


def _escape(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("'", "&apos;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = text.replace(plain, entity)
    return text


def properties_tokenizer(text: str, out: Parts) -> None:
    """One unit a key; a value goes on after a backslash at a line's end."""
    lines = re.findall(r"[^\n]*\n|[^\n]+\Z", text)
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        m = re.match(r"([^=#!\r\n]+?\s*=[ \t]*)(.*?)(\r?\n?)\Z", line, re.S)
        if not m or line.lstrip()[:1] in ("#", "!"):
            out.literal(line)
            continue
        value, end = m[2], m[3]
        while re.search(r"(?<!\\)(?:\\\\)*\\\Z", value) and i < len(lines):
            more = re.match(r"[ \t]*(.*?)(\r?\n?)\Z", lines[i], re.S)
            value, end, i = value[:-1] + more[1], more[2], i + 1
        out.literal(m[1])
        if value.strip():
            out.para(_escape(value), name=m[1].split("=")[0].strip())
        else:
            out.literal(value)
        out.literal(end)


def dtd_tokenizer(text: str, out: Parts) -> None:
    """One unit an entity; the lines of a value are joined by a space."""
    at = 0
    for m in re.finditer(r"""(?s)<!--.*?-->|(<!ENTITY\s+([\w.:-]+)\s+)(["'])(.*?)\3(\s*>)""", text):
        if not m[1] or not m[4].strip():
            continue
        out.literal(text[at : m.start()] + m[1] + m[3])
        # Values are XML text already: entities stay, other special characters become ones.
        value = re.sub(r"\s*\r?\n\s*", " ", m[4])
        out.para(re.sub(r"&(?![\w#]+;)", "&amp;", value).replace("<", "&lt;").replace(">", "&gt;"), name=m[2])
        out.literal(m[3] + m[5])
        at = m.end()
    out.literal(text[at:])


_QUOTED = re.compile(r'^\s*"((?:[^"\\]|\\.)*)"\s*$')


def po_tokenizer(text: str, out: Parts) -> None:
    """One unit an entry with a msgid; line breaks in it are codes. The skeleton holds the entry up to msgstr, then the unit."""
    entry, msgid, state = [], [], ""

    def close():
        nonlocal entry, msgid, state
        value = "".join(msgid)
        if state and value:
            # All but the old msgstr.
            kept = [x for kind, x in entry if kind != "msgstr"]
            tail = [x for kind, x in entry if kind == "msgstr"]
            out.literal("".join(kept) + 'msgstr "')
            pieces = value.split("\\n")
            lb = "".join
            done = []
            for k, piece in enumerate(pieces):
                done.append(_escape(piece.replace('\\"', '"').replace("\\\\", "\\")))
                if k < len(pieces) - 1:
                    done.append(f"<x id='{out.code(chr(92) + 'n')}' ctype='lb'/>")
            out.para(lb(done), name=value)
            out.literal('"\n' if tail else '"')
        else:
            out.literal("".join(x for _, x in entry))
        entry, msgid, state = [], [], ""

    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text):
        word = re.match(r"\s*(msgid|msgstr)\s+(\".*\")\s*$", line)
        if word and word[1] == "msgid" or not line.strip():
            if state == "msgstr" or not line.strip():
                close()
            if word:
                state = "msgid"
                msgid.append(_QUOTED.match(word[2])[1])
                entry.append(("msgid", line))
            else:
                out.literal(line)
        elif word:
            state = "msgstr"
            entry.append(("msgstr", line))
        elif (q := _QUOTED.match(line)) and state:
            if state == "msgid":
                msgid.append(q[1])
            entry.append((state, line))
        else:
            if state == "msgstr":
                close()
            entry.append(("comment", line))
    close()


_RC_LINE = re.compile(r"(?is)^(\s*(?:" + "|".join(RC_KEYWORDS) + r")\s+)(L)?\"((?:\"\"|[^\"])+)\"([,\s].*)?$")
_RC_STRING = re.compile(r"(?s)^(\s*[\w]+[\s,]+)(L)?\"((?:\"\"|[^\"])*)\"(.*)$")


def rc_decode(text: str, wide: bool) -> str:
    """Doubled quotes and hexadecimal escapes: two digits, or four in wide strings."""
    return re.sub(r"\\x([0-9A-Fa-f]{4})" if wide else r"\\x([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text.replace('""', '"'))


def rc_encode(text: str) -> str:
    """A quoted resource string; wide with escapes if it is not ASCII."""
    body = text.replace('"', '""')
    if body.isascii():
        return f'"{body}"'
    units = lambda c: [int.from_bytes(c.encode("utf-16-be")[i : i + 2], "big") for i in range(0, len(c.encode("utf-16-be")), 2)]
    return 'L"' + "".join(c if c.isascii() else "".join(f"\\x{u:04x}" for u in units(c)) for c in body) + '"'


def rc_tokenizer(text: str, out: Parts) -> None:
    """One unit a text of a statement or of a string table, quotes included in the unit's place."""
    table = depth = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text):
        bare = line.strip().upper()
        if re.match(r"STRINGTABLE\b", bare):
            table = 1
        m = None
        if table and depth:
            if bare in ("}", "END"):
                table = depth = 0
            else:
                m = _RC_STRING.match(line)
        elif table and (bare in ("{", "BEGIN") or bare.endswith("{") or bare.endswith(" BEGIN")):
            depth = 1
        elif not table:
            m = _RC_LINE.match(line)
        if not m or not m[3].strip():
            out.literal(line)
            continue
        out.literal(m[1])
        out.para(_escape(rc_decode(m[3], bool(m[2]))), name=m[1].split()[0])
        out.literal(m[4] or "")


TOKENIZERS = {"JAVA_PROPERTIES": properties_tokenizer, "XULDTD": dtd_tokenizer, "PO": po_tokenizer, "WINRC": rc_tokenizer}


def read(docs: DataFrame, kind: str, column: str = "text") -> DataFrame:
    return tokenise(docs, TOKENIZERS[kind], column)
