"""Credentials embedded in source code (problem 7).

Unnatural strings are those of few characters per subword under a public vocabulary. A literal is a candidate only if it is one, and context rules (assignments, headers, connection strings,
URLs, arguments, comments, key blocks; stand-ins, references, addresses, checksums) accept or reject it. The one exception are passwords that people choose, in words: those are found by
their context alone, and counted apart (`p7_kinds`). What is found is redacted in place: every character of a credential becomes an asterisk, so that all offsets, quotes and lines stay as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from unicodedata import normalize

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.bpe import Encoder, encoder
from codeloom.llm.encode import vocabulary

#: Characters per subword at or below which a string is unnatural: of letters alone (from the length at which words differ enough from chance), and with digits or symbols.
UNNATURAL = 2.4
JUDGED = 12
UNNATURAL_MIXED = 3.25

# The words that end the names of credentials, and words that make a name mean something else.
CREDENTIAL_WORDS = frozenset("password passwd pwd pw pass passphrase passcode secret secrets token bearer credential credentials apikey accesskey secretkey authtoken privatekey auth authorization psk pat creds cred sas kennwort passwort contraseña clave mdp пароль".split())
KEY_KINDS = frozenset("api access session deploy secret private signing sign encryption encrypt crypto hmac salt auth license licence account shared master storage service admin user client app application webhook ssh rsa subscription function server data integration publishable stripe aws azure gcp cookie jwt".split())
PHRASE_KINDS = frozenset("admin login user pass root db secret recovery seed backup wallet unlock master service sudo".split())
CODE_KINDS = frozenset("license licence access auth activation security recovery backup pairing".split())
OTHER_MEANING = frozenset("public endpoint url uri host path file filename name field header id ids type length len min max size ttl expiry expires count limit policy param label placeholder regex pattern sha1 sha256 sha512 md5 checksum digest hash integrity commit revision etag version format prefix column attribute index env var variable input prompt hint".split())
#: Names of what people choose in words.
CHOSEN = frozenset("password passwd pwd pw pass passphrase passcode phrase word kennwort passwort contraseña clave mdp пароль".split())
#: What names of credentials end with, whatever separates their words.
JOINED = ("password", "passwd", "passphrase", "dbpass", "apikey", "accesskey", "secretkey", "authtoken", "accesstoken", "sessionkey", "deploykey", "smtppw", "licensecode", "connectionauth", "signingsecret", "clientsecret", "webhooksecret", "hmacsaltkey")

#: Schemes, names in connection strings (regular expressions; the letters of each), and what bare tokens begin with or hold between two of - and _.
SCHEMES = ("bearer", "basic", "token", "apikey")
CONNECTION_NAMES = ("password", "pwd", "accountkey", "sharedaccesskey", "sharedaccesssignature", "secret", "access[_-]?token", "api[_-]?key", "token", "sig")
TOKEN_STARTS = ("AKIA", "eyJ", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "p_", "AIza")
TOKEN_PARTS = ("sk", "live", "prod", "api", "pat", "secret")


def _shortest(words: set[str]) -> tuple[str, ...]:
    """The words that hold no other."""
    return tuple(sorted(w for w in words if not any(o != w and o in w for o in words)))


def _forms(words: Iterable[str]) -> set[str]:
    """Words in lower case, with their accents as one character or two."""
    return {normalize(f, w.casefold()) for w in words for f in ("NFC", "NFD")}


#: Words one of which ends the name of a credential; substrings of lines worth a look (in lower case), from the rules: every line with a credential holds one, or a name in JOINED, or 'sig ='.
NAME_ENDS = _forms({*CREDENTIAL_WORDS, "key", "keys", "code", "codes", "phrase", "word", "words"})
TRIGGERS = _shortest({*NAME_ENDS, *SCHEMES, *(re.split(r"\[", w)[-1].split("?")[-1] for w in CONNECTION_NAMES if w != "sig"), *(w.lower() for w in TOKEN_STARTS), *(a + w + b for w in TOKEN_PARTS for a in "-_" for b in "-_"), "://"})
_TRIGGERS = tuple(t.encode() for t in TRIGGERS)
_SIG = re.compile(rb"sig[^a-z0-9=\n]*=")

#: How a line ends whose literal goes on in the next.
_GOES_ON = ('"', "'", "(", "+", "\\", "=", ":")

_MARK = "\u0300-\u036f"  # accents that are characters of their own
_NAME = rf"(?<![\w{_MARK}$@])(?!\d)[\w$@][\w{_MARK}.$@-]{{0,80}}"
_LETTERS = (("[A-Za-z]", "[A-Za-z_-]"), (rf"(?:[^\W\d_]|[{_MARK}])", rf"(?:[^\W\d]|[{_MARK}-])"))  # letters, and letters with _ and -: of ASCII lines, and of any
_QUOTED = r"(?:[fFrRbBuU@$]{0,2})(?P<q>[\"'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)++)(?P=q)"
#: A name, an optional type, and a quoted value; between them calls that read a setting with a default.
_ASSIGN = re.compile(rf"[\"'`]?(?P<k>{_NAME}(?: {_NAME}){{0,2}}?)[\"'`]?\]?\s*(?::\s*[\w.<>\[\]|? ]{{1,80}}?\s*)?(?:=>|:=|={{1,3}}|:)\s*(?:(?:[\w.]{{1,80}}\s*\([^()\n]{{0,200}}?,\s*(?:default\s*=\s*)?)|(?:[\w.]{{1,80}}(?:\([^()\n]{{0,200}}\)|\[[^\]\n]{{0,200}}\])?[\w.]{{0,80}}\s*(?:\|\||\?\?|\bor\b)\s*))?(?:\(\s*)?{_QUOTED}")
_XML = re.compile(r"(?:key|name)\s*=\s*([\"'])(?P<k>[^\"'\n]+)\1\s+value\s*=\s*([\"'])(?P<v>[^\"'\n]*)\3|<(?P<k2>[A-Za-z][\w.-]*)>(?P<v2>[^<>\n]+)</(?P=k2)>", re.I)
_PLAIN = re.compile(rf"(?:^|(?<=[\s;:?&#/*\"'`(,{{]))(?:export\s+)?-{{0,2}}(?P<k>{_NAME}(?: {_NAME})?)\s*(?:=|:\s)\s*(?P<v>[^\s\"'`]+)")
_FLAG = re.compile(rf"--(?P<k>{_NAME})[= ](?P<v>[^\s\"'`]+)")
_SPOKEN, _SPOKEN_ANY = (re.compile(rf"\b(?P<k>(?:{w}{{1,40}}[ _-]){{0,2}}(?!(?:was|is|are|to|now|of|as)\b){x}{{1,40}})(?!{x})(?:\s+(?:was|is|are|to|now|of|as)\b:?|\s*[:=])?\s+[`\"']?(?P<v>[^\s`\"']{{6,}})[`\"']?") for w, x in _LETTERS)
_TICKED, _TICKED_ANY = (re.compile(rf"[`\"'](?P<k>[\w{_MARK}.-]{{1,80}})[`\"']\s+(?:to|is|as|=|:)\s+[`\"'](?P<v>[^`\"'\s]+)[`\"']|\b(?P<k2>(?:{w}{{1,40}}[ _-]){{0,3}}{x}{{1,40}})\s+`(?P<v2>[^`\s]+)`") for w, x in _LETTERS)
_SCHEME = re.compile(rf"\b(?P<s>{'|'.join(SCHEMES)})\b\s*[\"'`]?\s*(?:[+.:,]\s*)?[\"'`]?\s?(?P<v>[A-Za-z0-9_\-.~+/=]{{8,}})", re.I)
_HEADER = re.compile(r"\b(?P<k>(?:X-)?[A-Za-z-]{0,40}(?:Auth|Token|Key|Secret)[A-Za-z-]{0,40})[\"'`]?\s*[:,]\s*[\"'`]?(?P<v>[^\s\"'`,;]{8,})", re.I)
#: A pair of user and password; a name-value pair on two lines; a literal that goes on in others.
_PAIR = re.compile(rf"(?P<k>{_NAME})[\"']?\s*[:=]\s*[(\[{{]\s*([\"'])[^\"'\n]*\2\s*,\s*([\"'])(?P<v>[^\"'\n]+)\3\s*[)\]}}]")
_NAMED = re.compile(rf"[\"']?name[\"']?\s*[:=]\s*[\"']?(?P<k>[\w{_MARK}.-]+)[\"']?,?\s*$", re.I)
_VALUE = re.compile(r"^\s*[-,]?\s*[\"']?value[\"']?\s*[:=]\s*[\"']?(?P<v>[^\s\"']+)[\"']?,?\s*$", re.I)
_OPENS = re.compile(rf"(?P<k>{_NAME})[\"'`]?\]?\s*(?::\s*[\w.]+\s*)?[:=]\s*\(?\s*(?P<first>[\"'][^\"'\n]*[\"'])?\s*[+\\]?\s*$")
_MORE = re.compile(r"^\s*[+.]?\s*([\"'])(?P<v>[^\"'\n]*)\1\s*(?P<on>[+\\]?)\s*(?P<end>[);,]*)\s*$")
_TOGETHER = re.compile(rf"(?P<k>{_NAME})[\"'`]?\]?\s*(?::\s*[\w.]+\s*)?[:=]\s*\(?\s*(?P<parts>([\"'])[^\"'\n]*\3(?:\s*\+?\s*([\"'])[^\"'\n]*\4)+)")
_USERINFO = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s:/@\"'`<>]{0,200}:(?P<v>[^\s/\"'`<>]+)@[\w\[.$-]")
_CONNECTION = re.compile(rf"(?:^|[;\"'`\s?&])(?P<k>{'|'.join(CONNECTION_NAMES)})\s*=\s*(?P<v>[^;\"'`\s&]+)", re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>[\s\S]*?)(?:-----END [A-Z0-9 ]*-----|\Z)")
#: The rest of a line, and the lines of a key's body that follow: base64, headers and blank ones, the last perhaps short.
_KEY_LINES = re.compile(r"[^\n]*(?:\n[\s\"'`,;>*#-]*+(?:[A-Za-z0-9+/]{24,}+={0,2}|[A-Z][A-Za-z-]+: [^\n]*)?(?:\\[rn])*[^\w\n]*(?=\n|\Z))*(?:\n[ \t\"'`>*#-]*+(?=[a-z]*[A-Z0-9+/=])[A-Za-z0-9+/]{1,23}+={0,2}(?:\\[rn])*[^\w\n]*(?=\n|\Z))?")
_BARE = re.compile(r"(?<![\w/+=-])(?:AKIA[0-9A-Z]{13,17}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*|gh[pousr]_\w{20,}|xox[abprs]-[\w-]{10,}|[a-z]{2,8}(?:[-_](?:" + "|".join(TOKEN_PARTS) + r"))+[-_][A-Za-z0-9]{16,}|[a-z]{2,8}p_[A-Za-z0-9]{16,}|AIza[\w-]{30,})(?![\w/+=-])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_ANY_WORDS = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lo}+|\d+")

# Words of sentences about passwords, which no passphrase is made of.
_TALK = frozenset("the your you this that must should may can not and for with from please enter wrong missing invalid required has have was were are will too short long reset forgot change confirm again match matches".split())
# Literals that stand in for a credential (matched whole, in lower case).
_STAND_IN = re.compile(
    r"<.*>|\[.*\]|\$\{.*\}|\$\(.*\)|\{\{.*\}\}|\{[\w.:-]*\}|%\w+%|%\(\w+\)s|\$\w+|@\w+@|#\{.*\}|__\w+__|(.)\1*|(?:[*x•.#?_-])\1*|[*x•#]{3,}.*|\.{2,}"
    r"|(?:your|my|the|some|any|insert|enter|put|add|use|set|new)[-_. ].*|.*[-_ ](?:here|goes[-_]here)"
    r"|.*(?:replace[-_ ]?(?:me|this|with)?|change[-_ ]?(?:me|this|it)|fill[-_ ]?(?:me|in|this)|placeholder|redacted|not[-_ ]?set|to[-_ ]?be[-_ ]?(?:set|filled|defined)|dummy|sample|example).*"
    r"|none|null|nil|undefined|empty|unset|true|false|n/?a|todo|tbd|fixme|secret|password|passwd|token|hidden|masked|default|string|str|changeit|test|foo|bar"
)
_REFERENCE = re.compile(r"(?:process\.env|os\.environ|environ|getenv|env|config|settings|vault|secret(?:s|smanager)?|ssm|arn|op|ref\+\w+|keyvault|kms|sops|file|data)(?::|\.|\[|\(|/).*|.*\b(?:getenv|environ|secretsmanager|secretkeyref)\b.*|(?:https?|file|s3|gs|vault|op)://.*|[./~]{0,2}/[\w./ -]*", re.I)
_INVISIBLE = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
_MIXED = re.compile(r"[a-z][A-Z]{2}|[A-Z]{2,}[a-z]+[A-Z]|(?:[a-z]+[A-Z]){3}")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_ADDRESS = re.compile(r"(?:[\w-]+\.)+[a-z]{2,}(?::\d+)?(?:/\S*)?|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?", re.I)
_SUM = re.compile(r"(?:sha\d+|md5)[-:].*", re.I)


def name_of(key: str) -> list[str]:
    return [w.lower() for w in (_WORDS.findall(key) if key.isascii() else _ANY_WORDS.findall(normalize("NFC", key)))]


def names_credential(key: str) -> bool:
    """Whether a name, by its last words, is that of a credential."""
    words = name_of(key)
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in OTHER_MEANING or "public" in words:
        return False
    last = words[-1]
    before = words[-2] if len(words) > 1 else ""
    if last in CREDENTIAL_WORDS or last in ("key", "keys") and (before in KEY_KINDS or len(words) > 2 and words[-3] in KEY_KINDS) or last in ("code", "codes") and before in CODE_KINDS or last in ("phrase", "word", "words") and before in PHRASE_KINDS:
        return True
    return "".join(words).endswith(JOINED)


_WORDY = regex.compile(r"\p{Lu}?\p{Ll}{2,}(?:[-_.]?(?:\p{Lu}?\p{Ll}{2,}|\d+))*+[^\w\s]*+")
_PHRASE = regex.compile(r"\p{Ll}{3,}(?:[ _-]\p{Ll}{3,}){2,}")


def chosen(value: str, key: str) -> bool:
    """Whether a value may be a password that someone chose in words, by its name alone: a phrase of three or more words in small letters, or words with numbers or symbols."""
    words = name_of(key)
    if not words or words[-1] not in CHOSEN and not "".join(words).endswith(JOINED):
        return False
    if any(c.isspace() for c in value):
        return bool(_PHRASE.fullmatch(value)) and not any(names_credential(w) or w in _TALK for w in value.replace("_", " ").replace("-", " ").split())
    return bool(_WORDY.fullmatch(value)) and not value.isalpha()


#: What follows from names_credential: the name ends with one of these words, no letter goes on, and at least the five characters of a value come later.
_NAME_ENDS = re.compile(rf"(?=(?:{'|'.join(sorted(NAME_ENDS))})(?![a-z])(?:\s*\S){{5}})[{''.join(sorted({w[0] for w in NAME_ENDS}))}]")
_SEPARATORS = bytes(c for c in range(256) if c != 10 and not (chr(c).isascii() and chr(c).isalnum()))
_JOINED = tuple(w.encode() for w in JOINED)
_ANY_JOINED = re.compile(b"|".join(_JOINED))


def may_name(line: str) -> bool:
    """Whether any rule on names can find a credential in a line: true for each line in which one does."""
    low = line.casefold()
    if not line.isascii():
        if _NAME_ENDS.search(low):
            return True
    elif any(not (i := m.start()) or not line[i - 1].isalpha() or line[i].isupper() for m in _NAME_ENDS.finditer(low)):  # where a word begins in name_of
        return True
    return bool(_ANY_JOINED.search(low.encode(errors="replace").translate(None, _SEPARATORS)))


def worth_a_look(text: str, ends: list[int]) -> set[int]:
    """Numbers from 0 of the lines in which a rule may find a credential. ends: the places of line ends."""
    low = text.casefold()
    if not text.isascii():
        for c in _INVISIBLE:
            low = low.replace(c, "")
    raw = low.encode(errors="replace")
    if not text.isascii():
        ends = [m.start() for m in re.finditer(b"\n", raw)]
    hits: set[int] = set()
    for t in _TRIGGERS:
        i = raw.find(t)
        while i >= 0:
            k = bisect_right(ends, i)
            hits.add(k)
            i = raw.find(t, ends[k] if k < len(ends) else len(raw))
    if b"sig" in raw:
        hits.update(bisect_right(ends, m.start()) for m in _SIG.finditer(raw))
    letters = raw.translate(None, _SEPARATORS)
    if any(w in letters for w in _JOINED):
        hits.update(k for k, x in enumerate(letters.split(b"\n")) if any(w in x for w in _JOINED))
    return hits


class Judge:
    """Rules on values; the vocabulary gives characters per subword."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.seen: dict[str, float] = {}

    def per_subword(self, value: str) -> float:
        if value in self.seen:
            return self.seen[value]
        n = len(value) / max(1, len(self.enc.encode([value])[0]))
        if len(value) <= 1000:  # longer ones are not kept
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[value] = n
        return n

    def unnatural(self, value: str) -> bool:
        return len(value) >= JUDGED and self.per_subword(value) <= UNNATURAL

    def candidate(self, value: str) -> bool:
        """Whether a literal is an unnatural string: by its characters per subword, below which no words of any length stay."""
        if any(c.isdigit() or not (c.isalnum() or c in "-_./:") for c in value):
            return self.per_subword(value) <= UNNATURAL_MIXED
        return (len(value) >= JUDGED or len(value) >= 8 and bool(_MIXED.search(value))) and self.per_subword(value) <= UNNATURAL

    def literal(self, value: str, key: str = "") -> bool:
        """Whether a value is a candidate, or one that people choose under that name, and no stand-in, reference, address, checksum or id."""
        v = value.strip()
        if not (self.candidate(v) or key and chosen(v, key)) or len(v) < 4:
            return False
        low = v.lower()
        if _STAND_IN.fullmatch(low) or _REFERENCE.fullmatch(v) and not (v[0] in "/." and self.random(v)) or _UUID.fullmatch(v) or _SUM.fullmatch(v):
            return False
        if any(c.isspace() for c in v) and not chosen(v, key):
            return False
        if _ADDRESS.fullmatch(v) and not (v.startswith("eyJ") or self.random(v)):
            return False
        return not ("${" in v or "{{" in v or "<" in v and ">" in v or v.isdigit())

    def random(self, value: str) -> bool:
        """Unnatural, with digits and capitals."""
        return self.unnatural(value) and any(c.isdigit() for c in value) and any(c.isupper() for c in value)

    def plain(self, value: str, key: str = "") -> bool:
        """Stricter, for values without quotes: no code."""
        code = r"[()\[\]{}]|=>|\w\.\w+\(" if value.startswith("eyJ") or self.random(value) else r"[()\[\]{}]|=>|\w\.\w+\(|^[\w.]+\.[a-z_]\w*$"
        return self.literal(value, key) and not re.search(code, value) and not re.fullmatch(r"[a-z_]+\d{0,3}|[A-Za-z]?[a-z]+(?:[A-Z][a-z]+)*\d{0,2}", value)


def _clean(value: str) -> str:
    """A plain value without punctuation that closes its sentence or statement."""
    return value.removesuffix(".").rstrip(",;)]}>\"'`")


def line_spans(line: str, judge: Judge) -> list[tuple[int, int]]:
    """Places of credentials within one line."""
    out: list[tuple[int, int]] = []

    def take(a: int, z: int) -> None:
        if z > a and not any(x < z and a < y for x, y in out):
            out.append((a, z))

    for m in _USERINFO.finditer(line) if "://" in line else ():
        if judge.literal(m["v"], "password") or not _STAND_IN.fullmatch(m["v"].lower()) and len(m["v"]) >= 5 and "{" not in m["v"] and "$" != m["v"][:1] and (any(not c.isalpha() for c in m["v"]) or _MIXED.search(m["v"])):
            take(*m.span("v"))
    for m in _BARE.finditer(line):
        if not _STAND_IN.fullmatch(m[0].lower()) and (m[0].startswith(("eyJ", "AKIA")) or judge.unnatural(m[0])):
            take(*m.span())
    low = line.casefold()
    for m in _SCHEME.finditer(line) if any(w in low for w in SCHEMES) else ():
        if judge.literal(m["v"]) and (judge.unnatural(m["v"]) or m["s"].lower() != "token" and any(c.isdigit() for c in m["v"]) and len(m["v"]) >= 16):
            take(*m.span("v"))
    for m in _CONNECTION.finditer(line) if "=" in line else ():
        if judge.literal(m["v"], m["k"]) and not re.search(r"[()\[\]]|^[a-z_.]+$", m["v"]):
            take(*m.span("v"))
    if not may_name(line):  # the rules below begin with the name of a credential
        return out
    spoken, ticked = (_SPOKEN, _TICKED) if line.isascii() else (_SPOKEN_ANY, _TICKED_ANY)
    at = 0
    while m := _ASSIGN.search(line, at):
        if names_credential(m["k"].split()[-1]) and judge.literal(m["v"], m["k"].split()[-1]):
            take(*m.span("v"))
        at = max(m.end("k"), at + 1)
    for m in _TOGETHER.finditer(line):
        pieces = [(p.start(2) + m.start("parts"), p[2]) for p in re.finditer(r"([\"'])([^\"'\n]*)\1", m["parts"])]
        if names_credential(m["k"]) and judge.literal("".join(p for _, p in pieces), m["k"]):
            for a, p in pieces:
                take(a, a + len(p))
    for m in _PAIR.finditer(line):
        if names_credential(m["k"]) and judge.literal(m["v"], "password"):
            take(*m.span("v"))
    for m in _XML.finditer(line):
        k, v = ("k", "v") if m["k"] else ("k2", "v2")
        if names_credential(m[k]) and judge.literal(m[v], m[k]):
            take(*m.span(v))
    for pattern in (_HEADER, ticked):
        for m in pattern.finditer(line):
            k, v = ("k", "v") if m["k"] else ("k2", "v2")
            if names_credential(m[k]) and judge.literal(m[v], m[k]) and (pattern is ticked or judge.unnatural(m[v])):
                take(*m.span(v))
    for pattern in (_PLAIN, _FLAG):
        at = 0
        while m := pattern.search(line, at):
            v, a = _clean(m["v"]), m.start("v")
            if names_credential(m["k"].split()[-1]) and judge.literal(m["v"], m["k"].split()[-1]) and judge.plain(v, m["k"].split()[-1]):
                take(a, a + len(v))
            at = max(m.end("k"), at + 1)
    at = 0
    while m := spoken.search(line, at):
        v, a = _clean(m["v"]), m.start("v")
        if names_credential(" ".join(m["k"].split()[-3:])) and judge.literal(m["v"], m["k"].split()[-1]) and judge.plain(v, m["k"].split()[-1]) and (judge.unnatural(v) or any(c.isdigit() for c in v) and any(not c.isalnum() for c in v)):
            take(a, a + len(v))
        at = line.find(" ", m.start() + 1)
        if at < 0:
            break
    return out


def over_lines(text: str, judge: Judge, ends: list[int], hits: set[int], apart: bool = False) -> list[tuple[int, int, int]]:
    """Spans of the rules that go over line ends: key blocks, values on the line after their name, literals that go on. Where lines need not follow each other (apart), a block without end holds what looks like lines of a key."""
    out: list[tuple[int, int, int]] = []
    at = 0
    while "PRIVATE KEY" in text and (m := _PEM.search(text, at)):
        a, z = m.span("v")
        if apart and ("-----BEGIN" in m["v"] or not text.startswith("-----END", z)):
            z = min(z, _KEY_LINES.match(text, a).end())
        at = z if apart else m.end()
        body = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", text[a:z])
        if len(body) >= 32 and (judge.per_subword(body[:200]) <= 3 or judge.per_subword(body) <= 3):
            out.append((a, z, bisect_right(ends, m.start() - 1) + 1))

    def line(k: int) -> tuple[int, str]:
        a = ends[k - 1] + 1 if k else 0
        return a, text[a : ends[k]] if k < len(ends) else text[a:]

    for k in sorted(hits):
        start, own = line(k)
        if k < len(ends) and "ame" in own.lower() and (m := _NAMED.search(own)) and names_credential(m["k"]):
            below, after = line(k + 1)
            if (v := _VALUE.match(after)) and judge.literal(v["v"], m["k"]):
                out.append((below + v.start("v"), below + v.end("v"), k + 2))
        if k < len(ends) and own.rstrip().endswith(_GOES_ON) and (m := _OPENS.search(own)) and names_credential(m["k"]):
            pieces = [(start + m.start("first") + 1, m["first"][1:-1], k + 1)] if m["first"] else []
            j = k + 1
            while j <= len(ends):
                below, after = line(j)
                if not (v := _MORE.match(after)):
                    break
                pieces.append((below + v.start("v"), v["v"], j + 1))
                j += 1
                if v["end"]:
                    break
            if len(pieces) > bool(m["first"]) and judge.literal("".join(p for _, p, _ in pieces), m["k"]):
                n = pieces[0][2]  # the credential begins on the line of its first piece
                out += [(x, x + len(p), n) for x, p, _ in pieces]
    return out


def spans(text: str, judge: Judge) -> list[tuple[int, int, int]]:
    """(start, end, 1-based line) of the credentials of a text; of key blocks, the body and the line of the opening."""
    ends = [m.start() for m in re.finditer("\n", text)]
    hits = worth_a_look(text, ends)
    if not hits:
        return []
    out = over_lines(text, judge, ends, hits)
    for k in sorted(hits):
        start = ends[k - 1] + 1 if k else 0
        own = text[start : ends[k]] if k < len(ends) else text[start:]
        a = start
        if not own.isascii() and (kept := [i for i, c in enumerate(own) if c not in _INVISIBLE]) and len(kept) < len(own):
            seen = line_spans("".join(own[i] for i in kept), judge)  # as a reader sees the line
            places = [(kept[x], kept[y - 1] + 1) for x, y in seen]
        else:
            places = line_spans(own, judge)
        for x, y in places:
            if not any(p < a + y and a + x < q for p, q, _ in out):
                out.append((a + x, a + y, k + 1))
    return sorted(out)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, z, _ in found:
        a = max(a, at)
        if z <= a:
            continue
        out += [text[at:a], re.sub(r"[^\s]", "*", text[a:z])]
        at = z
    return "".join([*out, text[at:]])


def evidence_spans(items: list[str | None], judge: Judge) -> list[list[tuple[int, int, int]]]:
    """Spans of each item, as spans() has them; then those of rules that go over line ends, on the items as lines of one text. A credential over several items has line 1 where it begins and 0 in the others."""
    found = [spans(t, judge) if t else [] for t in items]
    if len(items) < 2:
        return found
    text = "\n".join(t or "" for t in items)
    ends = [m.start() for m in re.finditer("\n", text)]
    if not (hits := worth_a_look(text, ends)):
        return found
    begins = [0]
    for t in items:
        begins.append(begins[-1] + len(t or "") + 1)
    for a, z, line in over_lines(text, judge, ends, hits, apart=True):
        first = bisect_right(begins, ends[line - 2] + 1 if line > 1 else 0) - 1
        for k in range(bisect_right(begins, a) - 1, len(items)):
            x, y = max(a, begins[k]), min(z, begins[k + 1] - 1)
            if begins[k] >= z:
                break
            if x < y:
                found[k].append((x - begins[k], y - begins[k], int(k == first)))
    return [sorted(f) for f in found]


_judges: dict[int, Judge] = {}


def _judge(raw: bytes) -> Judge:
    enc = encoder(raw)
    return _judges.setdefault(id(enc), Judge(enc))


def document_credentials(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, lines, redacted): 1-based lines of credentials (each once) and the redacted text. A null text stays null with no lines."""
    raw = vocabulary(documents, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(raw.value)
        for b in batches:
            lines, texts = [], []
            for t in b.column("text").to_pylist():
                found = spans(t, judge) if t else []
                lines.append(sorted({k for _, _, k in found}))
                texts.append(redact(t, found) if found else t)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lines, pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "lines", "redacted"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lines array<int>, redacted string")


def document_lines(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, line_no, unnatural) of credentials, and whether any on the line is an unnatural string; texts are not carried on."""
    raw = vocabulary(documents, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(raw.value)
        for b in batches:
            ids, lines, odd = [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found: dict[int, bool] = {}
                for a, z, k in spans(t, judge) if t else ():
                    found[k] = found.get(k, False) or judge.candidate(t[a:z])
                ids += [i] * len(found)
                lines += found
                odd += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(odd, pa.bool_())], names=["doc_id", "line_no", "unnatural"])

    return documents.where("text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id bigint, line_no int, unnatural boolean")


def risk_credentials(risks: DataFrame, folder: str | None = None) -> DataFrame:
    """(risk_id, lines, evidence): 1-based positions in evidence at which credentials begin, and the redacted evidence. Null evidence and null items stay so."""
    raw = vocabulary(risks, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(raw.value)
        for b in batches:
            lines, texts = [], []
            for items in b.column("evidence").to_pylist():
                found = evidence_spans(items or [], judge)
                opens = ["PRIVATE KEY-----" in t and "BEGIN" in t if t else False for t in items or ()]
                lines.append([k for k, (f, o) in enumerate(zip(found, opens), 1) if any(n for *_, n in f) or o])
                texts.append(None if items is None else [redact(t, f) if f else t for t, f in zip(items, found)])
            yield pa.RecordBatch.from_arrays([b.column("risk_id"), pa.array(lines, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))], names=["risk_id", "lines", "evidence"])

    return risks.select("risk_id", "evidence").mapInArrow(run, "risk_id string, lines array<int>, evidence array<string>")


def p7_found(documents: DataFrame, risks: DataFrame) -> DataFrame:
    d = document_lines(documents).select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("owner_id"), "line_no")
    r = risk_credentials(risks.select("risk_id", "evidence").distinct()).select(F.lit("risks").alias("origin"), F.col("risk_id").alias("owner_id"), F.explode("lines").alias("line_no"))
    return d.unionByName(r).distinct()


def p7_kinds(documents: DataFrame) -> DataFrame:
    """Places in documents by what found them: unnatural strings that the context accepts (subwords), or the context alone (context)."""
    return document_lines(documents).groupBy(F.when(F.col("unnatural"), "subwords").otherwise("context").alias("kind")).agg(F.count("*").alias("n_places"))


def p7_redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with every credential redacted."""
    return document_credentials(documents).select("doc_id", F.col("redacted").alias("text"))


def p7_redacted_risks(risks: DataFrame) -> DataFrame:
    """(risk_id, evidence) with every credential redacted; one row per row of risks."""
    return risk_credentials(risks).select("risk_id", "evidence")
