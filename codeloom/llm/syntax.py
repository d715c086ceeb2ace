"""Source files that do not parse (problem 4).

Every text, of whatever language and size, is cut into chunks at line ends. A chunk is a map from the lexer states in which it may begin to the state in which it then ends and a bracket summary: its token codes with
all balanced groups reduced, from the inside out, by local grammars (codeloom.llm.grammar). Such maps compose associatively: within a block of chunks where the block is read, between
blocks by a second reduction over partitions. What remains of a text is one short string of balanced statements, which the statement grammar reads piece by piece.

Lexer states have no bound (templates and f-strings nest), so a map holds the modes that chunks usually begin in, as if nothing were open around them; that serves every state around which stays
open. A state that a chunk leaves (closes) from inside is looked at anew, in that chunk alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.lineage import cut
from codeloom.llm.grammar import END, grammar
from codeloom.parse.lexer import _LINE_ENDS, _LINE_STARTS, LINE, joined, lex
from codeloom.tables import source_documents

#: Characters of a chunk, and chunks of a block.
CHUNK = 4096
BLOCK = 64
#: Modes of a map, besides code.
MODES = {"typescript": ("c", "t", "m"), "c_sharp": ("c", "v", "i"), "python": ('s"""', "s'''")}
MODES["javascript"] = MODES["typescript"]
#: What must stand in a chunk that begins in a mode, for it to end in another.
LEAVES = {"c": ("*/",), "t": ("`", "${"), "m": ("`", "${"), "v": ('"',), "i": ('"', "{", "}")}

#: Exit state and bracket summary; no summary is an error.
Entry = tuple[str, str | None]


def chunks(text: str, size: int) -> list[str]:
    """The text in pieces of about size characters that end at line ends which no backslash joins."""
    out, a = [], 0
    while len(text) - a > size:
        z = text.find("\n", a + size) + 1
        while z and text[max(a, z - 3) : z - 1].rstrip("\r").endswith("\\"):
            z = text.find("\n", z) + 1
        if not z:
            break
        out.append(text[a:z])
        a = z
    return [*out, text[a:]]


def entry(chunk: str, lang: str, state: str, rich: bool = True) -> Entry:
    """Where a chunk that begins in a state ends, and its summary. rich: whether its text may hold patterns."""
    lexed = lex(chunk, lang, state)
    if lexed.state == "error":
        return "error", None
    codes = "".join([t[0] for t in lexed.tokens])
    summary = grammar(lang).reduce(codes, rich)
    return (lexed.state, summary) if summary is not None else ("error", None)


class Map:
    """The entries of one or more adjacent chunks by state. Where the text is at hand, entries are found when asked for."""

    def __init__(self, lang: str, found: dict[str, Entry], text: str | None = None, rich: bool = True):
        self.lang, self.found, self.text, self.rich = lang, found, text, rich

    def get(self, state: str) -> Entry | None:
        """None where the state needs a look at the text, and it isn't here."""
        if state in self.found:
            return self.found[state]
        mode, _, around = state.partition("|")
        if mode == "/" and (e := self.found.get(joined("", around.split(",") if around else []))) and not self.slash():
            return (joined("/", [x for x in e[0].partition("|")[2].split(",") if x]), "") if e[1] == "" and e[0].partition("|")[0] == "" else e
        if around and (e := self.get(mode)) is not None:
            end, summary = e
            outer = around.split(",")
            if summary is not None and (out := self._around(outer, end, summary)) is not None:
                return out, summary
        if self.text is None:
            return None
        self.found[state] = entry(self.text, self.lang, state, self.rich)
        return self.found[state]

    def slash(self) -> bool:
        """Whether the chunk may begin with a slash that is no comment."""
        return self.text is None or self.text.lstrip()[:1] == "/" and self.text.lstrip()[:2] not in ("//", "/*")

    def _around(self, outer: list[str], end: str, summary: str) -> str | None:
        """The state at the end with what was open around the start; None where that does not stay open."""
        if self.lang == "python":
            if not outer[-1].isdigit():
                return None
            shut = sum(map(summary.count, ")]}"))
            gained = sum(map(summary.count, "([{"))
        else:
            shut, gained = summary.count("}"), summary.count("{")
        count = int(outer[-1].rstrip("v"))
        if shut > count or self.lang == "python" and any(x in summary for x in (":", "!")):
            return None  # a colon may begin a format
        mode, _, inner = end.partition("|")
        opened = gained if not inner else _before_hole(summary)
        last = str(count - shut + opened) + ("v" if outer[-1].endswith("v") else "")
        return joined(mode, [*outer[:-1], last, *(inner.split(",") if inner else [])])


def _before_hole(summary: str) -> int:
    """Unmatched braces that open before the first unmatched hole."""
    return summary[: summary.index("$")].count("{")


def chunk_map(chunk: str, lang: str, first: bool, rich: bool = True) -> Map:
    m = Map(lang, {}, chunk, rich)
    m.get("")
    if not first:
        for mode in MODES[lang]:
            leaves = LEAVES.get(mode, (mode[1:],))
            m.found[mode] = entry(chunk, lang, mode, rich) if any(x in chunk for x in leaves) or lang == "python" and "\\" in chunk else (mode, "")
        if lang in ("typescript", "javascript") and m.slash():
            m.get("/")
    return m


def compose(a: Map, b: Map, states: list[str]) -> dict[str, Entry | str]:
    """The entries of two adjacent maps for states; a text in place of an entry is the state that b needs a look at."""
    out: dict[str, Entry | str] = {}
    for state in states:
        e = a.get(state)
        if e is None:
            continue
        mid, left = e
        if left is None:
            out[state] = e
            continue
        f = b.get(mid)
        if f is None:
            out[state] = mid
            continue
        end, right = f
        if right is None:
            out[state] = ("error", None)
            continue
        line = LINE if a.lang in ("typescript", "javascript") and mid.partition("|")[0] in ("", "/") and left and right and right[0] in _LINE_STARTS and (left[-1] in _LINE_ENDS or left[-1] == END) else ""
        both = grammar(a.lang).reduce(left + line + right, a.rich)
        out[state] = ("error", None) if both is None else (end, both)
    return out


def block_map(text: str, lang: str, first: bool, size: int, rich: bool = True) -> Map:
    """The map of a block: those of its chunks, composed pair by pair. A first block begins in code."""
    maps = [chunk_map(c, lang, first and k == 0, rich) for k, c in enumerate(chunks(text, size))]
    while len(maps) > 1:
        pairs = []
        for k in range(0, len(maps) - 1, 2):
            a, b = maps[k], maps[k + 1]
            both = (a.text or "") + (b.text or "")
            pairs.append(Map(lang, compose(a, b, list(a.found)), both, rich))
        maps = pairs + maps[len(maps) // 2 * 2 :]
    return maps[0]


def whole(codes: str, lang: str, rich: bool = True) -> bool:
    """Whether the token codes of a text are a whole module or compilation unit."""
    reduced = grammar(lang).reduce(codes, rich)
    return reduced is not None and ends_well(("", reduced), lang)


def ends_well(e: Entry, lang: str) -> bool:
    end, summary = e
    return end in ("", "/") and summary is not None and not any(b in summary for b in "()[]{}$") and grammar(lang).whole(summary)


def valid(text: str, lang: str, size: int = CHUNK) -> bool:
    """Whether a text follows the grammar of its language. An empty one does. A leading byte order mark is no part of it."""
    return ends_well(block_map(text.removeprefix("\ufeff"), lang, True, size, grammar(lang).rich(text)).get(""), lang)


def _first_pass(size: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "code_language"))):
                blocks = chunks(t.removeprefix("\ufeff"), size * block)
                if len(blocks) == 1:
                    rows.append((i, valid(blocks[0], lang, size), None, None, None))
                else:
                    rows += [(i, None, lang, k, x) for k, x in enumerate(blocks)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.string()))], names=["doc_id", "ok", "code_language", "block_no", "block"])

    return run


_MAP = "doc_id bigint, code_language string, block_no int, entry string, exit string, summary string"


def _block_maps(size: int):
    """Entries of blocks; with a column state, that of the state alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column("state").to_pylist() if "state" in b.schema.names else [None] * b.num_rows
            rows = []
            for i, lang, k, t, state in zip(*(b.column(c).to_pylist() for c in ("doc_id", "code_language", "block_no", "block")), asked):
                m = block_map(t, lang, k == 0, size)
                found = m.found if state is None else {state: m.get(state)}
                rows += [(i, lang, k, s, *e) for s, e in found.items()]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))], names=["doc_id", "code_language", "block_no", "entry", "exit", "summary"])

    return run


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    """The verdict of a text from the maps of its blocks, or the block and state that need a look."""
    lang = pdf["code_language"].iloc[0]
    maps = [Map(lang, {s: (e, None if pd.isna(c) else c) for s, e, c in zip(g["entry"], g["exit"], g["summary"])}) for _, g in pdf.sort_values("block_no").groupby("block_no")]
    whole_map, ok, block, state = maps[0], None, None, None
    for k, m in enumerate(maps[1:], 1):
        e = compose(whole_map, m, [""])[""]
        if isinstance(e, str):
            block, state = k, e
            break
        whole_map = Map(lang, {"": e})
    else:
        ok = ends_well(whole_map.get(""), lang)
    return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "ok": [ok], "block_no": pd.array([block], "Int32"), "state": [state]})


def verdicts(sources: DataFrame, size: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(doc_id, ok) of sources (doc_id, text, code_language). Empty texts are valid; null ones are left out; repeated rows are judged each, unless they have more than one block. No rows give none.

    Texts of one block are decided where they are read; the blocks of longer ones are dealt over the cluster, and their maps meet by text.
    """
    s = sources.where("text is not null").select("doc_id", "text", "code_language")
    first = cut(s.mapInArrow(_first_pass(size, block), "doc_id bigint, ok boolean, code_language string, block_no int, block string"))
    known, long = first.where("block is null").select("doc_id", "ok"), first.where("block is not null").drop("ok").dropDuplicates(["doc_id", "block_no"])
    if long.isEmpty():
        return known
    maps = cut(long.repartition("doc_id", "block_no").mapInArrow(_block_maps(size), _MAP))
    while True:
        out = cut(maps.groupBy("doc_id").applyInPandas(_combine, "doc_id bigint, ok boolean, block_no int, state string"))
        asked = out.where("state is not null")
        if asked.isEmpty():
            return known.unionByName(out.select("doc_id", "ok"))
        more = long.join(asked.select("doc_id", "block_no", "state"), ["doc_id", "block_no"]).mapInArrow(_block_maps(size), _MAP)
        maps = cut(maps.unionByName(more))


def p4_found(documents: DataFrame, files: DataFrame) -> DataFrame:
    return verdicts(source_documents(documents.select("doc_id", "file_id", "text"), files)).where("not ok").select("doc_id").distinct()


def p4_rates(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Source files, those that do not parse and their share, by repository (documents.source) and language of the path."""
    src = source_documents(documents.select("doc_id", "file_id", "text", "source"), files)
    bad = verdicts(src).where("not ok").select("doc_id").distinct().withColumn("bad", F.lit(1))
    g = src.select("doc_id", "source", "code_language").join(bad, "doc_id", "left").groupBy("source", "code_language")
    return g.agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"), F.round(F.count("bad") / F.count("*"), 6).alias("rate"))
