"""Problem 1: find credentials in source text and blank them.

One automaton (see ``automaton``) joins token formats, key armour, connection
strings and credential names.  It runs over overlapping windows of all texts
of an Arrow batch; the ends it reports, deduplicated by absolute position,
select the few lines that an exact check then reads.  The check finds the
value's absolute span, or rejects it as a placeholder, reference, checksum or
the like.  ``redact`` splices a placeholder over each span and leaves all
other characters, line ends included, as they are.

Defined results: a null or empty text has no findings and is returned as it
is; equal rows give equal findings; columns besides the key and the text are
kept by ``redact``.  A private key block is one finding, at its opening
marker, and its span reaches to the closing marker or the last body line.
"""

from __future__ import annotations

import base64
import bisect
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekspark.llm.automaton import compile_grammars

# Public token formats.  Each has a short prefix for the automaton and the full form.
TOKEN_FORMATS = {
    "github": (r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]{16,255}"),
    "github_pat": (r"github_pat_[A-Za-z0-9_]", r"github_pat_[A-Za-z0-9_]{20,}"),
    "gitlab": (r"glpat\-[A-Za-z0-9_\-]", r"glpat-[A-Za-z0-9_\-]{20,}"),
    "slack": (r"xox[abeoprs]\-[A-Za-z0-9\-]", r"xox[abeoprs]-[A-Za-z0-9\-]{20,}"),
    "aws": (r"A(KI|SI|RO|ID)A[A-Z0-9]", r"A(?:KI|SI|RO|ID)A[A-Z0-9]{16}"),
    "google": (r"AIza[A-Za-z0-9_\-]", r"AIza[A-Za-z0-9_\-]{30,}"),
    "npm": (r"npm_[A-Za-z0-9]", r"npm_[A-Za-z0-9]{30,}"),
    "stripe": (r"[rs]k_live_[A-Za-z0-9]", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    "sk": (r"sk\-[A-Za-z0-9\-]", r"sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}"),
    "sendgrid": (r"SG\.[A-Za-z0-9_\-]", r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}"),
    "pypi": (r"pypi\-Ag[A-Za-z0-9_\-]", r"pypi-Ag[A-Za-z0-9_\-]{30,}"),
    "shopify": (r"shp(at|ca|pa|ss)_[a-f0-9]", r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}"),
    "hub": (r"hf_[A-Za-z]", r"hf_[A-Za-z]{30,}"),
    "droplet": (r"do[opr]_v1_[a-f0-9]", r"do[opr]_v1_[a-f0-9]{64}"),
    "oauth": (r"ya29\.[A-Za-z0-9_\-]", r"ya29\.[A-Za-z0-9_\-]{20,}"),
    "age": (r"AGE\-SECRET\-KEY\-1", r"AGE-SECRET-KEY-1[0-9A-Z]{50,}"),
    "jwt": (r"eyJ[A-Za-z0-9_\-]", r"eyJ[A-Za-z0-9_\-]{6,}\.eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{10,}"),
    # Any issuer's tokens: a short prefix, perhaps a word, and a long run of letters in both cases and digits.
    "prefixed": (r"[\"'`=: (]([a-z]+[0-9]\.|[a-z]+[0-9]?[\-_])[a-z0-9_\-]*[A-Z]", r"[a-z]{2,4}[0-9]?[-_.](?:[a-z]{3,6}[-_])?(?=(?:[A-Za-z_\-]*[0-9]){2})(?=[a-z0-9_\-]*[A-Z])(?=[A-Z0-9_\-]*[a-z])[A-Za-z0-9_\-]{20,}(?![A-Za-z0-9_(.])"),
}
NAME_WORDS = (
    "pass(word|wd|phrase|wort|code|_key)?|pwd|pw|kennwort|geheimnis|contrase(na|nia|\xf1a)|clave([_\\-]?(de_)?acceso)?"
    "|mot_?de_?passe|secret|token|credentials?|creds?|pin|auth|login"
    "|(api|access|private|signing|master|encryption|account|storage|service|shared|session|hmac|license|secret|deploy|webhook|cipher|aes|rsa)[_\\- ]?key"
)
# Every grammar is a short bounded prefix, so that the automaton stays small and any match fits the overlap of
# two windows; the line it selects is then read in full by the exact check.
GRAMMARS = {name: anchor for name, (anchor, _) in TOKEN_FORMATS.items()} | {
    "armor": r"\-\-\-\-\-BEGIN |PuTTY\-User\-Key\-File",
    "connection": r"://",
    "parameter": r"[?&;](access_token|token|api_?key|key|password|pwd|secret|client_secret|sig|signature|auth|code)=",
    "webhook": r"/services/T[A-Z0-9]",
    "header": r"bearer|basic|api\-?key|authorization|private\-token",
    "decode": r"(atob|b64decode|base64_?decode|decode_?base64|fromBase64(String)?|decodestring|decode64|unhexlify|fromhex|Buffer\.from|getDecoder\(\)\.decode|decodeString)\(",
    "call": r"(connect|sign_?in|create_?client|usernamepassword[a-z]*)\(",
    "pieces": r"[\"'`][ \t]*[+\\]|[\"'`][ \t]*[.&][ \t]*[\"'`]|join\(|\[[ \t]*" + "\r?\n",
    "name": NAME_WORDS,
    "key_remark": r"key (for|was|is|of|in|until|to)|\(key\)|key: ",
}
FOLDED = frozenset({"parameter", "header", "decode", "call", "name", "key_remark"})


@lru_cache(maxsize=1)
def automaton():
    return compile_grammars(GRAMMARS, FOLDED)


_TOKEN = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(f"(?P<{n}>{full})" for n, (_, full) in TOKEN_FORMATS.items()) + ")")
_NAME = re.compile(rf"(?i)(?:{NAME_WORDS.replace('(', '(?:')})$")
_PLACE = re.compile(
    r"(?i)^(?:x{3,}|\*+|\.{2,}|-+|_+|#+|0+|1234\d*|abc(?:123|def)?\w{0,3}|foo(?:bar)?|bar|baz|null|none|nil|undefined|true|false|dummy.*|test(?:ing)?[_-]?(?:\d{0,4}|(?:pass(?:word|wd)?|pw|pwd|token|secret|key|api_?key|user|value|auth|login|cred\w*)[_-]?\d{0,4})|sample.*|todo|tbd|n/?a|"
    r"redacted|removed|secret|password|passwd|pwd|pass|token|changeit|hunter2?|qwerty|admin|root|user|guest|"
    r".*(?:example|placeholder|replace[_-]?me|change[_-]?me|changeme|insert|your[_-]|[_-]here|my[_-]?(?:password|secret|token)|dummy|fake|redacted|not[_-]?a[_-]?real|fill[_-]?in|set[_-]?me|put[_-]).*)$"
)
_REFER = re.compile(
    r"\$\{|\$\(|\{\{|\}\}|<%|%\(|^<.*>$|^\$[A-Za-z_]|^%[A-Z_]{2,}%$|^%[sdv]$|^\{[A-Za-z_.]*\}$|^@[A-Za-z]+@$|^(?:process\.env|os\.environ|env|vault|ssm|secretsmanager|op|ref\+\w+)[.:(\[/]|^!(?:Ref|Sub|GetAtt)|^arn:|^projects/"
)
_HEX = re.compile(r"^[0-9a-f]{32,}$|^[0-9A-F]{32,}$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
_WORDY = re.compile(r"^[a-z]+(?:[-_./ ][a-z]+)*$|^[A-Z]+(?:[_ -][A-Z]+)*$|^[A-Z]?[a-z]+(?:[A-Z][a-z]+)*$")
_QUOTED = re.compile(r"""([rbuf]{0,2})("{3}|'{3}|["'`])((?:\\.|(?!\2).)*)(\2|$)""", re.S)
_ASSIGN = re.compile(
    r"""(?<![\w$])\d*([A-Za-z_$][\w$.\-]*)["'`\])]{0,3}(?:\s*:\s*[A-Za-z_][\w<>\[\]|. ]*(?=\s*=[^=>]))?[ \t]*(?::=|=>|=(?![=>])|:(?![:/]))\s*"""
)
_PAIR = re.compile(r"""[({]\s*(["'])([\w.\-/:]+)\1\s*,\s*(?=[rbuf]{0,2}["'`])""")
_ATTRIBUTE = re.compile(r"""(?i)\b(?:key|name|id)\s*=\s*(["'])([\w.\-:]+)\1[^<>]*?(?:\bvalue\s*=\s*(?=["'])|>(?=[^<>\s]{4,}</))""")
_SUFFIX = re.compile(r"_?\d+$|_(?:prod|production|stag|stage|staging|dev|devel|development|test|testing|qa|uat|live|local|sandbox|preprod|ci|eu|us|old|new|current|prev|previous|backup|primary|secondary|v\d+|value|default)$")
# The value on the line after its name: a literal that is no key itself, a decoding call or a lookup.
_NEXT_LINE = re.compile(r"""\n[ \t]*(?=([rbuf]{0,2})(["'`])(?:\\.|(?!\2)[^\n])*\2(?![ \t]*(?::|=[^=]))|[\w.]{0,40}(?i:decode|atob|env|fromhex|Buffer\.from|fromBase64))""")
_ENV_DEFAULT = re.compile(r"""(?:\?\?|\|\||\bor\b|,|:-|\?:|else)\s*$""")
_LOOKUP = re.compile(
    r"(?i)(?:env(?:iron)?\b|getenv|process\.env|vault|config\.get|secrets?\.get|settings\.|keyring|getpass|prompt|read_?secret|ssm|load_?secret|require\(|import |fetch|input\()"
)
_CALL = re.compile(r"(?i)\b(?:login|auth|authenticate|connect|sign_?in|set_?password|credentials?|create_?client|usernamepassword\w*)\(([^()]*)\)?")
_REMARK = re.compile(r"^\s*(?:[^\"'`]*?\s)??(?://|#|/\*|\*|--|<!--|;|%|\"\"\"|''')\s*(.*?)(?:\*/.*)?$")
_DECODE = re.compile(
    r"""(?i)(?:atob|b64decode|base64_?decode|decode_?base64|fromBase64(?:String)?|decodestring|decode64|unhexlify|fromhex|Buffer\.from|getDecoder\(\)\.decode|decodeString)\(\s*b?(["'`])([A-Za-z0-9+/=_\-]{6,})\1"""
)
_JOIN = re.compile(r"""(["'`])[ \t]*(?:\+|\.|\\|&)?[ \t]*\r?(?:\n[ \t]*)?(?:\+[ \t]*)?[fbru]?(["'`])""")
_CONN = re.compile(r"""([A-Za-z][A-Za-z0-9+.\-]*)://([^/\s:@"'`]*):([^/\s"'`]+)@(?=[\w\[$<{.\-])""")
_PARAM = re.compile(r"""(?i)[?&;](?:access_token|token|api_?key|key|password|pwd|secret|client_secret|sig|signature|auth)=([^&\s"'`#]{6,})""")
_HOOK = re.compile(r"/services/(T[A-Z0-9]{4,}/B[A-Z0-9]{4,}/[A-Za-z0-9]{16,})")
_HEAD = re.compile(
    r"""(?i)\b(bearer|basic|token|x-api-key|api-key|apikey|x-auth-token|private-token|authorization)["'`]?\]?\s*[:=, ]\s*["'`]?(?:(bearer|basic|token|apikey|api-key)[ =:]+["'`]?)?([A-Za-z0-9+/=._~\-]{8,})(?![A-Za-z0-9+/=._~\-(\[{$])"""
)
# A header's value up to the quote that ends it, whatever its signs.
_HEAD_QUOTED = re.compile(
    r"""(?i)\b(?:authorization|x-api-key|api-key|x-auth-token|private-token)(?:["'`]?\]?\s*[:=,]\s*(?=["'`])|(?=:))(?:(["'`])|:[ \t]*)(?:(?:bearer|token|apikey)[ =:]+)?([^"'`\s]{6,})(?(1)\1|["'`])"""
)
# Literals joined by an operator, or an array of literals joined to one.
_PIECES = re.compile(r"""(["'`])[ \t]*(?:\+|\.|&|\\)?[ \t]*\r?\n?[ \t]*(?:\+[ \t]*)?[fbru]?(?=["'`])""")
_ARRAY = re.compile(r"""(?:["']{2}\.join\(\s*)?\[((?:\s*(?:"[^"\n]*"|'[^'\n]*'|`[^`\n]*`)\s*,?){2,}\s*)\](?:\s*\.join\(\s*(?:""|\'\'|``)\s*\))?""")
_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|PuTTY-User-Key-File-\d(?::[ \t]*[\w\-]*)?")
_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|Private-MAC:[^\r\n]*")
# What a block without a closing marker goes on with: header lines, quotes and joins, base64.
_BLOCK = re.compile(r"""(?:\\[nr]|[A-Za-z][A-Za-z\-]{0,39}: (?:(?!\\[nr])[^\r\n"'`])*|[\s"'`+|>#*/\\]|[A-Za-z0-9+/=:,\-])*""")


def _mixed(value: str) -> bool:
    """Not a plain word, identifier or prose: has a digit, or mixes cases and signs like a password."""
    if _WORDY.match(value):
        return False
    return bool(re.search(r"\d", value) or re.search(r"[^\w\s.\-/:]", value) and re.search(r"[A-Za-z]", value) or re.search(r"[a-z]", value) and re.search(r"[A-Z].*[A-Z]", value))


_PROSE = re.compile(
    r"(?i)\b(?:your|the|an?|is|are|to|enter|must|please|for|of|and|or|not|no|invalid|required|missing|wrong|with|in|be|at|least|if|forgot|reset|show|hide|new|old|confirm|der|die|das|ein|ihr|le|la|el|de|un|una|une|votre|su|es|est)\b"
)
_PHRASE_NAME = re.compile(r"(?i)(?:pass(?:word|wd|phrase|wort|code)?|pwd|pw|kennwort|contrase(?:na|nia|\xf1a)|clave|mot_?de_?passe)(?:[^a-z]|$)")
_STOCK = re.compile(
    r"(?i)^(?:string|text|str|boolean|number|integer|object|hidden|required|optional|unknown|default|varchar|char|bytes|input|disabled|enabled|none|empty|missing|invalid|value|field|label|login|basic|bearer|plain|username|email)$"
)


def _path(v: str) -> bool:
    """A file or URL path, rather than a random value that begins with a slash."""
    if not re.match(r"^(?:~|\.{1,2})?/", v):
        return False
    if not re.fullmatch(r"[\w.\-~/@:*{}$]*", v):
        return False
    return not any(len(p) >= 12 and re.search(r"\d", p) and re.search(r"[a-z].*[A-Z]|[A-Z].*[a-z]", p) for p in v.split("/"))


def _expression(v: str) -> bool:
    """A pattern, list, group or object as a whole, rather than a value that begins with such a sign."""
    return v[0] + v[-1] in ("[]", "()", "{}") or v[0] == "^" and (v[-1] == "$" or bool(re.search(r"\\[dwsb]|\[[^\]]*\]|\(\?", v)))


def _phrase(v: str) -> bool:
    """A pass phrase or a password of letters only: no prose about passwords, stock word or name of a credential."""
    words = re.split(r"[\s_\-./]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v))
    return len(v) >= 8 and len(words) <= 10 and not _STOCK.match(v) and not _PROSE.search(" ".join(words)) and not any(re.search("^(?:" + _FLAT + ")s?$", w.lower()) for w in words)


def usable(value: str, name: str = "") -> bool:
    """Whether a literal can be a working secret; below a password's ``name`` letters alone or several words can."""
    v = value.strip()
    if len(v) < 4 or _PLACE.match(v) or _REFER.search(v) or _UUID.match(v):
        return False
    phrase = bool(_PHRASE_NAME.search(name)) and _phrase(v)
    if re.search(r"\s", v) and not v.startswith(("Bearer ", "Basic ")):
        return phrase and bool(re.fullmatch(r"[^\s()<>{}\[\];=]+(?: [^\s()<>{}\[\];=]+){2,9}", v))
    if "BEGIN PUBLIC KEY" in v or "CERTIFICATE" in v or v.startswith(("data:", "http://", "https://", "s3://")) or _path(v) or _expression(v):
        return False
    if len(set(v)) < 4:
        return False
    if re.match(r"^[\d.,:]+$", v) and len(v) < 6:
        return False
    if re.match(r"^(?:sha\d+[-:]|v?\d+\.\d+)", v):
        return False
    return phrase or _mixed(v)


def _bytes(value: str) -> bytes:
    """The bytes behind base64 or hex; none if it is neither."""
    try:
        if re.fullmatch(r"(?:[0-9a-fA-F]{2}){6,}", value):
            return bytes.fromhex(value)
        s = value.rstrip("=").replace("-", "+").replace("_", "/")
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except ValueError:
        return b""


def _decoded(value: str) -> str | None:
    """The printable text behind base64 or hex, or None."""
    try:
        text = _bytes(value).decode("utf-8")
    except ValueError:
        return None
    return text if text and text.isprintable() else None


def _hidden(value: str, name: str = "") -> bool:
    """Whether the literal of a decoding call under a credential's name holds a secret: a usable text, a key block or varied bytes."""
    text = _decoded(value)
    if text is not None:
        return usable(text, name) or usable(text, "password") or bool(_TOKEN.search(text))
    raw = _bytes(value)
    if b"-----BEGIN " in raw:
        return b"PRIVATE KEY" in raw
    return len(raw) >= 8 and len(set(raw)) >= 6


def _plain_name(name: str) -> bool:
    """A name that ends in a credential word, in any case style; digits and an environment's name may follow it."""
    last = re.split(r"[.]", name.rstrip("_"))[-1]
    flat = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", last).lower().replace("-", "_")
    while m := _SUFFIX.search(flat):
        flat = flat[: m.start()]
    return bool(re.search(r"(?:^|_)(?:" + _FLAT + r")$", flat)) and not re.search(r"(?:^|_)(?:public|verify|max|min|num|count|next_page|csrf_field|primary|foreign|sort|cache|partition)_(?:key|token)$|(?:^|_)(?:public|verify)_(?:\w+_)?key$", flat)


_FLAT = (
    r"(?:[a-z]*_)?(?:pass(?:word|wd|phrase|wort|code)?|pwd|pw|kennwort|geheimnis|contrase(?:na|nia|\xf1a)|clave(?:_(?:de_)?acceso)?|mot_?de_?passe|motdepasse|claveacceso|secret|token|credentials?|creds?|pin|auth|login|"
    r"(?:api|access|private|signing|master|encryption|account|storage|service|shared|session|hmac|license|secret|deploy|webhook|cipher|aes|rsa)_?key|apikey|dbpass|userpass|secret_?key_?base)"
)


def _literal(text: str, at: int):
    """The quoted literal at ``at``, adjoining pieces (``"a" + "b"``) joined: (value, start of value, end of value)."""
    m = _QUOTED.match(text, at)
    if not m:
        return None
    value, start, end = m.group(3), m.start(3), m.end(3)
    while True:
        j = _JOIN.match(text, end)
        if not j or m.group(2) not in "\"'`" or j.group(1) != m.group(2):
            break
        q = j.group(2)
        stop = text.find(q, j.end())
        if stop < 0:
            break
        value, end = value + text[j.end() : stop], stop
        if "\n" in text[j.end() : stop]:
            break
    return value, start, end


def _line_findings(text: str, lo: int, hi: int):
    """Findings (start, end, kind) whose value begins on the line text[lo:hi], or on the next for list elements."""
    line = text[lo:hi]
    tail = text[lo : min(len(text), hi + 400)]
    found: list[tuple[int, int, str]] = []
    for m in _BEGIN.finditer(line):
        at = lo + m.end()
        following = _BEGIN.search(text, at)
        stop = _END.search(text, at, following.start() if following else len(text))
        if not _BODY.search(text, at, min(stop.start() if stop else len(text), at + 1000)):
            continue
        found.append((lo + m.start(), stop.end() if stop else _open_end(text, at), "private_key"))
    for m in _TOKEN.finditer(line):
        v = m.group()
        if not re.search(r"(?i)example|placeholder|x{6,}|dummy|your", v) and len(set(v)) > 6 and not (m.lastgroup == "jwt" and "eyJzdWIiOiIxMjM0NTY3ODkwIiwi" in v):
            found.append((lo + m.start(), lo + m.end(), m.lastgroup or "token"))
    for m in _CONN.finditer(line):
        v = m.group(3)
        if len(v) >= 3 and not _PLACE.match(v) and not _REFER.search(v) and not v.startswith(("$", "<", "{", "%", "*", ":")):
            found.append((lo + m.start(3), lo + m.end(3), "connection"))
    for m in _PARAM.finditer(line):
        if usable(m.group(1)):
            found.append((lo + m.start(1), lo + m.end(1), "url"))
    for m in _HOOK.finditer(line):
        if not re.search(r"(?i)x{6,}|example", m.group(1)):
            found.append((lo + m.start(1), lo + m.end(1), "webhook"))
    for m in _HEAD.finditer(line):
        scheme, v = (m.group(2) or m.group(1)).lower(), m.group(3)
        if scheme == "basic":
            text_ = _decoded(v)
            if text_ and ":" in text_ and len(text_.partition(":")[2]) > 2 and not _PLACE.match(text_.partition(":")[2]):
                found.append((lo + m.start(3), lo + m.end(3), "basic"))
        elif (scheme == "bearer" or m.group(1).lower() not in ("token", "basic")) and usable(v) and re.search(r"\d", v) and len(v) >= 12:
            found.append((lo + m.start(3), lo + m.end(3), "bearer" if scheme == "bearer" else "header"))
    for m in _HEAD_QUOTED.finditer(line):
        if usable(m.group(2)):
            found.append((lo + m.start(2), lo + m.end(2), "header"))
    found += _joined(text, lo, hi)
    for m in _DECODE.finditer(line):
        names = [a.group(1) for a in _ASSIGN.finditer(line, 0, m.start())]
        if _TOKEN.search(_decoded(m.group(2)) or "") or names and _plain_name(names[-1]) and _hidden(m.group(2), names[-1]):
            found.append((lo + m.start(2), lo + m.end(2), "encoded"))
    for m in _ASSIGN.finditer(line):
        if not _plain_name(m.group(1)):
            continue
        found += _value(text, lo, hi, lo + m.end(), m.group(1))
    for m in _CALL.finditer(line):
        literals = [x for x in _QUOTED.finditer(line, m.start(1), m.end(1))] if m.group(1) else []
        if len(literals) >= 2 and usable(literals[-1].group(3)) and not re.match(r"https?:|\w+://", literals[-1].group(3)) and (re.search(r"\d|[^\w\s\-./]", literals[-1].group(3))):
            found.append((lo + literals[-1].start(3), lo + literals[-1].end(3), "call"))
    m = re.search(r"""(?i)(?:add_?header|set_?header|setRequestProperty|header|set)\(\s*["'](?:x-api-key|api-key|x-auth-token|private-token)["']\s*,\s*["']([^"']+)["']""", line) or re.search(
        r"""(?i)["'](?:x-api-key|api-key|x-auth-token|private-token)["']\]?\s*[:=]\s*["']([^"']+)["']""", line
    )
    if m and usable(m.group(1)):
        found.append((lo + m.start(1), lo + m.end(1), "header"))
    found += _remark(line, lo)
    m = re.match(r"""\s*(?:-\s*)?["']?(?:name|key)["']?\s*:\s*["']?([\w.\-]+)["']?,?\s*\r?\n\s*["']?value["']?\s*:\s*""", tail)
    if m and _plain_name(m.group(1)):
        at = lo + m.end()
        end = text.find("\n", at)
        found += _value(text, at, len(text) if end < 0 else end, at, m.group(1))
    for m in _PAIR.finditer(line):
        if _plain_name(m.group(2).replace("/", ".").replace(":", ".")):
            found += _value(text, lo, hi, lo + m.end(), m.group(2))
    for m in _ATTRIBUTE.finditer(line):
        if not _plain_name(m.group(2).replace(":", ".")):
            continue
        if line[m.end() - 1] != ">":
            found += _value(text, lo, hi, lo + m.end(), m.group(2))
        elif usable(v := line[m.end() : line.index("<", m.end())], m.group(2)):
            found.append((lo + m.end(), lo + m.end() + len(v), "assigned"))
    for m in re.finditer(r"""<([\w.:\-]+)(?:\s[^<>]*)?>([^<>\s]{4,})</\1>""", line):
        if _plain_name(m.group(1)) and usable(m.group(2), m.group(1)):
            found.append((lo + m.start(2), lo + m.end(2), "assigned"))
    return found


def _joined(text: str, lo: int, hi: int):
    """Literals in pieces from this line on that give a known token under any name, or a usable value under a credential's."""
    line, found = text[lo:hi], []
    if _PIECES.search(text, lo, min(len(text), hi + 200)):
        for q in re.finditer(r"""(?<![\w\\])[rbuf]{0,2}["'`]""", line):
            got = _literal(text, lo + q.start())
            if got and _real_token(got[0]) and not _TOKEN.match(text, got[1]):
                found.append((got[1], got[2], "token"))
    if "[" in line:
        for m in _ARRAY.finditer(text, lo, min(len(text), hi + 400)):
            if m.start() >= hi:
                break
            if "join(" not in m.group():
                continue
            pieces = list(re.finditer(r"""(["'`])((?:(?!\1)[^\n])*)\1""", m.group(1)))
            value = "".join(p.group(2) for p in pieces)
            names = [a.group(1) for a in _ASSIGN.finditer(text, lo, m.start())]
            if _real_token(value) or names and _plain_name(names[-1]) and usable(value, names[-1]):
                found.append((m.start(1) + pieces[0].start(2), m.start(1) + pieces[-1].end(2), "token" if _real_token(value) else "assigned"))
    return found


def _real_token(value: str) -> bool:
    """Whether the value begins with a token of a known format that is no documented example."""
    m = _TOKEN.match(value)
    return bool(m) and not re.search(r"(?i)example|placeholder|x{6,}|dummy|your", value) and len(set(value)) > 6


def _open_end(text: str, at: int) -> int:
    """Where a key block without a closing marker ends: after its last long run of base64 and a short last line."""
    last = at
    for m in _BODY.finditer(text, at, _BLOCK.match(text, at).end()):
        last = m.end()
    m = re.compile(r"(?:\\[nr]|[\r\n])+[ \t]*=?[A-Za-z0-9+/]{1,15}={0,2}(?![A-Za-z0-9+/= \t:(.])").match(text, last)
    return m.end() if m else last


def _value(text: str, lo: int, hi: int, at: int, name: str = ""):
    """The value assigned at ``at``: a literal, a bare word, a decoding call, or the default of a lookup."""
    rest = text[at:hi]
    skip = len(rest) - len(rest.lstrip(" \t("))
    at += skip
    rest = rest[skip:]
    if not rest.strip(" \t\r\\("):
        m = _NEXT_LINE.match(text, hi)
        if not m:
            return []
        end = text.find("\n", m.end())
        return _value(text, m.end(), len(text) if end < 0 else end, m.end(), name)
    bare_end = re.match(r"""[^\s"'`,;#]*(?:[#][^\s"'`,;]+)?""", rest)
    if rest.startswith(("|", ">")) and re.match(r"[|>][+\-]?\s*$", rest):
        nxt = re.compile(r"\s*\n([ \t]+)([^\s]+)[ \t]*(?:\r?\n|$)").match(text, at + len(rest.rstrip()))
        if nxt and "BEGIN" not in nxt.group(2) and usable(nxt.group(2), name):
            return [(nxt.start(2), nxt.end(2), "assigned")]
        return []
    m = re.match(r"[rbuf]{0,2}[\"'`]", rest)
    if m:
        got = _literal(text, at)
        if not got or got[1] > hi:
            return []
        value, start, end = got
        if value.startswith("-----BEGIN") or not usable(value, name):
            plain = None if value.startswith("-----BEGIN") else _maybe_joined_token(value)
            return [(start, end, "assigned")] if plain else []
        return [(start, end, "assigned")]
    if _LOOKUP.match(rest) or _LOOKUP.search(rest[:40]):
        for q in _QUOTED.finditer(rest):
            if _ENV_DEFAULT.search(rest[: q.start()]) and usable(q.group(3), name) and not q.group(3).startswith("secret/"):
                return [(at + q.start(3), at + q.end(3), "default")]
        return []
    d = _DECODE.match(rest) or re.match(r"(?:[\w.]+\.)?" + _DECODE.pattern.replace("(?i)", "(?i:") + ")", rest)
    if d:
        return [(at + d.start(2), at + d.end(2), "encoded")] if _hidden(d.group(2), name) else []
    word = bare_end.group() if bare_end else ""
    following = rest[len(word) :].lstrip()
    if word and (not following or following.startswith(("#", "//"))) and "(" not in word and not word.endswith(("{", "[")) and not re.match(r"^[A-Za-z_][\w.]*(?:\[\w*\])?$", word):
        return [(at, at + len(word), "assigned")] if usable(word) else []
    if word and not following and re.match(r"^[A-Za-z_]\w*$", word) and usable(word) and re.search(r"\d", word) and re.match(r"^\s*(?:export\s+)?[\w.\-\"']+\s*[:=]\s*$", text[lo:at]):
        return [(at, at + len(word), "assigned")]
    return []


def _maybe_joined_token(value: str) -> bool:
    return bool(_TOKEN.search(value))


_REMARK_NAME = re.compile(rf"(?i)\b(?:[\w]*[_-])?(?:{NAME_WORDS.replace('(', '(?:')}|key)\b")


_DIGEST = re.compile(r"(?i)\b(?:commit|sha\d*|md5|hash|digest|checksum|revision|rev|etag|build|id|uuid|fingerprint)\b")


def _remark(line: str, lo: int):
    """A value given in words inside a comment: ``// old password was X``, ``# key for staging: X``."""
    m = _REMARK.match(line)
    if not m or not _REMARK_NAME.search(m.group(1)):
        return []
    at = m.start(1)
    found = []
    for w in re.finditer(r"\S+", line[at:]):
        v = w.group()
        lead = len(v) - len(v.lstrip("\"'`(<"))
        v = v.strip("\"'`(),<>;")
        if "=" in v and re.match(r"^[A-Za-z_][\w.\-]*=[^=]", v) and _plain_name(v.partition("=")[0]) | (not v.endswith("=")):
            lead += v.index("=") + 1
            v = v.partition("=")[2]
        v = v.rstrip(".")
        before = line[at : at + w.start()]
        if (
            len(v) >= 8
            and _REMARK_NAME.search(before + (w.group() if lead else ""))
            and re.search(r"[0-9]", v)
            and re.search(r"[A-Za-z]", v)
            and (not _HEX.match(v) or not _DIGEST.search(before))
            and not re.match(r"^(?:https?:|[\w/]+\.\w+$|v?\d[\d.,:%]*\w{0,3}$|\w+\(|@|sha\d|#\d+$|\d{4}-\d\d)", v)
            and usable(v)
        ):
            found.append((lo + at + w.start() + lead, lo + at + w.start() + lead + len(v), "remark"))
    return found


def find_spans(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """For every text its findings as (start, end, kind), sorted and without overlaps."""
    row, end, _ = automaton().scan(texts)
    out: list[list] = [[] for _ in texts]
    last = (-1, -1)
    for r, e in zip(row.tolist(), end.tolist()):
        t = texts[r]
        lo = t.rfind("\n", 0, max(0, e - 1)) + 1
        if (r, lo) == last:
            continue
        last = (r, lo)
        hi = t.find("\n", lo)
        out[r] += _line_findings(t, lo, len(t) if hi < 0 else hi)
    return [_merged(spans) for spans in out]


def _merged(spans):
    if len(spans) < 2:
        return spans
    kept: list[tuple[int, int, str]] = []
    for s in sorted(set(spans), key=lambda x: (x[0], -x[1], x[2])):
        if kept and s[0] < kept[-1][1]:
            if s[1] > kept[-1][1]:
                kept[-1] = (kept[-1][0], s[1], kept[-1][2])
            continue
        kept.append(s)
    return kept


# Inside a key block: header lines and escaped line ends, which stay, or base64 down to the last short line.
_KEY_TEXT = re.compile(r"""(\\[nr]|:?[ \t]*\b[A-Za-z][A-Za-z\-]{0,39}: (?:(?!\\[nr])[^\r\n"'`])*)|[A-Za-z0-9][A-Za-z0-9+/=]*|[+/=][A-Za-z0-9+/=]{3,}""")
FOUND = T.ArrayType(T.StructType([T.StructField("line_no", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
PLACEHOLDER = "[REDACTED:{}]"


def splice(text: str, spans) -> str:
    """The text with each span replaced; a key block keeps its markers and line count."""
    parts, at = [], 0
    for s, e, kind in spans:
        inner = text[s:e]
        if kind == "private_key":
            head = re.match(_BEGIN.pattern + r"|\S+", inner)
            foot = _END.search(inner)
            keep_from, keep_to = s + head.end(), s + (foot.start() if foot else len(inner))
            body = _KEY_TEXT.sub(lambda m: m.group(1) or "[REDACTED]", text[keep_from:keep_to])
            parts += [text[at:keep_from], body]
            at = keep_to
            continue
        pieces = re.split(r"""(["'`][ \t]*(?:\+|\\|,|\.|&)?[ \t]*\r?\n?[ \t]*(?:\+[ \t]*)?[fbru]?["'`])""", inner)
        parts.append(text[at:s])
        parts += [PLACEHOLDER.format(kind) if k == 0 else (p if k % 2 else "") for k, p in enumerate(pieces)]
        at = e
    parts.append(text[at:])
    return "".join(parts)


def _scan_batches(frames):
    for pdf in frames:
        texts = [t if isinstance(t, str) else "" for t in pdf["__text"]]
        rows = []
        for i, (text, spans) in enumerate(zip(texts, find_spans(texts))):
            if not spans:
                continue
            breaks = [m.start() for m in re.finditer("\n", text)]
            rows += [(pdf["__key"].iat[i], bisect.bisect_left(breaks, s) + 1, s, e, kind) for s, e, kind in spans]
        yield pd.DataFrame(rows, columns=["key", "line_no", "start", "end", "kind"])


def find(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row (key, line_no, start, end, kind) per finding.  A row with a null text has none; repeated rows repeat theirs."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.where(F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return narrow.mapInPandas(_scan_batches, f"key {kind}, line_no long, start long, end long, kind string")


def redact(df: DataFrame, text: str = "text", into: str = "redacted") -> DataFrame:
    """All columns of ``df`` and the text with every secret value replaced by a placeholder, as ``into``, in place of a
    column of that name."""

    @F.pandas_udf("string")
    def cleaned(column: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in column]
        spans = find_spans(texts)
        return pd.Series([old if old is None else splice(old, s) if s else old for old, s in zip(column, spans)], dtype=object)

    return df.withColumn(into, cleaned(F.col(text)))
