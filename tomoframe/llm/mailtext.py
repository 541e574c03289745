"""The sentences of a mail's text parts: decoded, without headers, greetings, signatures, attribution lines and attachments."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
_FIELD = re.compile(r"^([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*(?:\n[ \t]+.*)*)", re.M)
_BOUNDARY = re.compile(r"""boundary\s*=\s*(?:"([^"]*)"|([^\s;]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*"?([^\s;"]+)""", re.I)
_TAG = re.compile(r"<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|<[^<>]*>", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|li|tr|h[1-6]|blockquote|table|ul|ol)\b[^>]*>", re.I)
_QUOTE = re.compile(r"^(?:[ ]?[>|][ ]?)+")
_WHEN = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d")
_QUOTED_HEADER = re.compile(r"^(?:From|Sent|To|Cc|Subject|Date|Reply-To|Message-ID): ?", re.I)
_RULE = re.compile(r"^(?:[*_=~#-]{3,}|-{2,}.*-{2,})$")
#: In a paragraph without capitals a sentence may begin with a small letter.
_SMALL_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*[ \n]+(?=\S)|(?<=[。！？])(?=.)", re.S)
_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*[ \n]+(?=[^\sa-zа-яß-öø-ÿ])|(?<=[。！？])(?=.)", re.S)
_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_UTF8_AS_LATIN = re.compile(r"[\u00c3\u00c2\u00c4\u00c5\u00d0\u00d1\u00e3\u00e2][\u0080-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2022\u2026\u2030\u2039\u203a\u20ac\u2122]")
_HIGH = re.compile("[\u00c0-\u00ff]")
_LETTER = re.compile(r"[^\W\d_]")


def _bytes(text: str) -> bytes:
    """The bytes that a text was before it was read as Western European."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode("latin-1")
        except UnicodeEncodeError:
            out += c.encode("cp1252", "replace")
    return bytes(out)


def repaired(text: str) -> str:
    """A text whose bytes were read in the wrong character set, read again."""
    if len(_UTF8_AS_LATIN.findall(text)) >= 2:
        again = "\n".join(_again(line) for line in text.split("\n"))
        if len(_UTF8_AS_LATIN.findall(again)) * 2 < len(_UTF8_AS_LATIN.findall(text)):
            text = again
    high = len(_HIGH.findall(text))
    if high > 20 and high > 0.4 * len(_LETTER.findall(text)):
        raw = _bytes(text)
        read = [raw.decode(c, "replace") for c in ("cp1251", "koi8-r", "shift_jis")]
        text = max(read, key=_plausible)
    return text


def _again(line: str) -> str:
    return _bytes(line).decode("utf-8", "replace") if _UTF8_AS_LATIN.search(line) else line


def _plausible(text: str) -> float:
    """Small letters of Cyrillic and kana speak for a reading, capitals inside words against it."""
    small = len(re.findall("[а-яё\u3040-\u30ff\u4e00-\u9fff]", text))
    return small - 2 * len(re.findall("[а-яёa-z][А-ЯЁ]", text)) - 2 * text.count("\ufffd") - len(re.findall("[\uff61-\uff9f]", text))


def _decoded(body: str, transfer: str, charset: str) -> str:
    charset = charset.lower()
    if transfer == "base64":
        clean = _BASE64.sub("", body.split("=", 1)[0] if "=" in body else body)
        clean = clean[: len(clean) - (len(clean) % 4 == 1)]
        try:
            raw = base64.b64decode(clean + "=" * (-len(clean) % 4))
        except (binascii.Error, ValueError):
            return ""
    elif transfer == "quoted-printable":
        raw = quopri.decodestring(body.encode("utf-8"))
    elif charset.startswith("iso-2022") and "\x1b" in body:
        raw = body.encode("utf-8")
    else:
        return body
    for name in (charset or "utf-8", "utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8" if charset in ("", "utf-8", "us-ascii") else "latin-1", "replace")


def _split_header(text: str) -> tuple[str, str]:
    text = text.lstrip("\n")
    if not _HEADER.match(text):
        return "", text
    at = re.search(r"\n[ \t]*\n", text)
    return (text[: at.start()], text[at.end() :]) if at else (text, "")


def text_parts(text: str) -> list[str]:
    """The decoded text parts of a mail, in order and however deep they are nested; parts with a file name are attachments."""
    out: list[str] = []
    stack = [(text, True)]
    while stack:
        text, whole = stack.pop()
        header, body = _split_header(text)
        fields = {m[1].lower(): m[2] for m in _FIELD.finditer(header)}
        kind = fields.get("content-type", "text/plain")
        low = kind.lower()
        boundary = _BOUNDARY.search(kind)
        inner = None
        if boundary:
            mark = "--" + (boundary[1] or boundary[2] or "").strip()
            parts = re.split(r"^" + re.escape(mark) + r"(?:--)?[ \t]*$", body, flags=re.M)
            closed = re.search(r"^" + re.escape(mark) + r"--[ \t]*$", body, flags=re.M)
            inner = parts[1:] if not closed else parts[1 : len(parts) - 1] or parts[1:]
        elif not header and text.startswith("--") and whole:  # the header is gone, the parts are there
            mark = text.split("\n", 1)[0].strip()
            if len(mark) > 4:
                inner = re.split(r"^" + re.escape(mark) + r"(?:--)?[ \t]*$", text, flags=re.M)[1:]
        if inner is not None:
            stack += [(p[1:] if p.startswith("\n") else p, False) for p in reversed(inner)]
            continue
        if not low.lstrip().startswith("text/") or "name=" in low or fields.get("content-disposition", "").lower().startswith("attachment"):
            continue
        charset = _CHARSET.search(kind)
        part = _decoded(body, fields.get("content-transfer-encoding", "").strip().lower(), charset[1] if charset else "").replace("\r\n", "\n")
        if "html" in low:
            part = html.unescape(_TAG.sub("", _BLOCK.sub("\n\n", part)))
        out.append(repaired(part))
    return out


def _flows(part: str) -> list[list[str]]:
    """Paragraphs that follow each other without an attribution line, a rule, a signature or a change of quoting between them."""
    flows: list[list[str]] = [[]]
    lines: list[str] = []
    level, in_signature, in_header = 0, False, False

    def paragraph() -> None:
        if lines:
            flows[-1].append("\n".join(lines))
            lines.clear()

    def turn() -> None:
        paragraph()
        if flows[-1]:
            flows.append([])

    for raw in part.split("\n"):
        m = _QUOTE.match(raw)
        line = (raw[m.end() :] if m else raw).strip()
        depth = sum(raw.count(c, 0, m.end()) for c in ">|") if m else 0
        if depth != level and (line or depth < level):
            turn()
            level, in_signature, in_header = depth, False, False
        if not line:
            paragraph()
            in_signature = in_header = False
        elif line == "--":
            turn()
            in_signature = True
        elif _RULE.match(line):
            turn()
            in_signature = False
            in_header = "message" in line.lower()
        elif _WHEN.search(line) and line[-1:] in ":：":  # says who wrote what follows
            turn()
            in_signature = False
        elif in_header and _QUOTED_HEADER.match(line):
            turn()
        elif not in_signature:
            in_header = False
            lines.append(line)
    paragraph()
    return [f for f in flows if f]


def split(paragraph: str) -> list[str]:
    """A paragraph cut after each sentence's end."""
    return (_END if paragraph != paragraph.lower() or not _LETTER.search(paragraph) else _SMALL_END).split(paragraph)


def flows(text: str) -> list[list[str]]:
    """The paragraphs of each flow of text of a mail."""
    return [f for part in text_parts(text.replace("\r\n", "\n").replace("\r", "\n")) for f in _flows(part)]


def sentences(text: str) -> list[list[str]]:
    """The sentences of each flow of text of a mail. A sentence has a letter and ends with a full stop or the like; what has no
    such end, as greetings and names have, is none. A flow goes on over paragraphs."""
    out = []
    for flow in flows(text):
        found = [s for paragraph in flow for s in split(paragraph) if s[-1:] in ".!?…。！？\"'”’)" and _LETTER.search(s)]
        if found:
            out.append(found)
    return out


_ADDRESS = re.compile(r"\S*(?:/|@)\S*")


def unpunctuated(text: str) -> list[str]:
    """The paragraphs of a mail, without addresses: what there is to read where no sentence has an end."""
    return [p for flow in flows(text) for paragraph in flow if (p := _ADDRESS.sub(" ", paragraph).strip())]
