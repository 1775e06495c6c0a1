"""Records that hold template residue, error pages or filler in place of content.

1. Records are cut into messages (sentences, lines) whose numbers are masked.
2. Templates are mined with a prefix tree of fixed depth. A message's path is
   its number of tokens, its first and its last token; a leaf's template keeps
   the tokens that all its messages have at a position and has a slot elsewhere.
   A path is a function of the message alone and templates come from least and
   largest tokens, so mining is one aggregation whose result doesn't depend on
   order, partitions or any bound, and no task compares messages.
3. Every template is classified once. Seeds (a short public vocabulary of error
   pages, script notices and filler) label the templates that hold them; a
   text model fitted on a bounded sample of labelled templates judges the other
   templates, each by the model that has not seen it; templates that stand
   mostly among such messages (links back, references) are margin.
4. Verdicts go back to the messages of a template, and so to the records. A
   message with a seed of its own keeps its verdict whatever its template says.

Unresolved slots inside ordinary records are detected separately, in the text
without code and quotations. Everything but the model runs as built-in
expressions over the texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch

#: Positions of a template that are told apart; what follows the last is one slot.
DEPTH = 12
#: Leaves that a task gathers before it hands them on.
HELD = 100_000
#: Most labelled templates (of either label) that the model is fitted on, taken by hash; fewest of either that it needs.
SAMPLE, ENOUGH = 20_000, 30
#: Hashed features, passes and strength of regularisation of the model; chance from which a template is residue.
WIDTH, PASSES, RIDGE, SURE = 1 << 18, 80, 1e-4, 0.5
#: A template is margin if it stands so often, in more than one record, among text that is such messages to this part on average.
TIMES, AMONG = 3, 0.5
SLOT = "<*>"

# --- placeholders (expressions of Java's dialect) ------------------------------

_ID = r"[A-Za-z][\w.]*(?: [\w.]+){0,3}"
_CAPS = r"[A-Z][A-Z_.]*[A-Z]"
PLACEHOLDER = r"(?=[{\[(<%$#@!&~^|*=+:«_])(?:" + "|".join(
    [
        # brackets in pairs around a name: {{x}}, {{{x}}}, [[x]], ((x)), <<x>>, {%x%}, <%x%>, {#x#}, <?x?>, [%x%], ${{x}}
        rf"\{{\{{\{{?[-#/!&^>@$]?\s*{_ID}(?:\s*[|:]\s*[\w. '()]+)*\s*\}}?\}}\}}",
        rf"\[\[\s*{_ID}\s*\]\]|\(\(\s*{_ID}\s*\)\)|<<\s*[A-Za-z][\w.]*\s*>>(?!\s*$)|\[%\s*{_ID}\s*%\]|\[#\s*{_ID}\s*#\]",
        rf"\{{[%#$@!:=]\s*{_ID}\s*[%#$@!:=]?\}}|<[%?#$]=?-?\s*{_ID}\s*[%?#$]>|<[#$@][A-Za-z][\w.]*>|\[[$@=:][A-Za-z][\w.]*\]",
        # a sigil before brackets: ${x}, #{x}, %{x}, @{x}, $(x), %(x)s, ${{x}}
        rf"[$#%@!&~]\{{\s*[A-Za-z][\w. ]*\s*\}}|[$#@]\(\s*[A-Za-z][\w.]*\s*\)|%\([A-Za-z]\w*\)[sdfr]",
        # the same sign on both sides of a name in capitals: %%X%%, @@x@@, ##X##, __X__, ~~X~~, $X$, %X%, |*X*|, *|X|*
        rf"%%[A-Za-z][\w.]*%%|@@[A-Za-z][\w.]*@@|##{_CAPS}##|\$\${_CAPS}\$\$|~~{_CAPS}~~|\^\^[A-Za-z]\w*\^\^|!!{_CAPS}!!|\|\|{_CAPS}\|\||=={_CAPS}==|\+\+{_CAPS}\+\+|::{_CAPS}::",
        rf"(?<![A-Za-z0-9_])__{_CAPS}__(?![A-Za-z0-9_])|%{_CAPS}%|\${_CAPS}\$|(?<![\w#])#{_CAPS}#(?!\w)|(?<![\w@])@{_CAPS}@(?!\w)|\^{_CAPS}\^",
        r"\*\|[A-Za-z][\w:.]*\|\*|\|\*[A-Za-z][\w:.]*\*\|",
        # words of a form: [INSERT NAME], [NAME HERE], [Your name], <YOUR_NAME>, <insert name>, «Name», YOUR_NAME_HERE
        r"\[(?:INSERT|ENTER|ADD|YOUR|PUT|FILL IN|TYPE|SELECT|CHOOSE) [A-Za-z][A-Za-z_. ]*\]|\[[A-Za-z][A-Za-z_. ]* (?:HERE|GOES HERE|here|goes here)\]|\[(?:Your|Enter|Insert|Add|your|enter|insert) [a-z][a-z_. ]*\]",
        r"<[A-Za-z][A-Za-z_]*_HERE>|<(?:INSERT|YOUR|ENTER|ADD)[_ ][A-Z_ ]+>|<(?:insert|your|enter|add)[_ -][a-z_ -]+>|\((?:INSERT|YOUR|ENTER|ADD) [A-Z_ ]+\)",
        r"«[A-Z][a-z_]+(?: [A-Z][a-z_]+){0,2}»",
        # format strings: {name}, {0}, %s
        r"(?<![\w$#%{])\{[a-z][a-z_]*(?:\.[a-z_]+)*\}(?!\})|(?<![\w$#%{])\{\d\}(?!\})|(?<=\s)%[sd](?=[\s.,;:!?]|$)",
    ]
) + r")"
#: Placeholders that are words; looked for only in texts that hold one of PLACEHOLDER_ENDS.
PLACEHOLDER_WORDS = r"\b(?:INSERT|YOUR|ENTER)(?:_[A-Z]+)+_HERE\b|\b[A-Z]+_PLACEHOLDER\b|\bPLACEHOLDER_[A-Z]+\b|\b(?:REPLACE|CHANGE)_ME\b"
PLACEHOLDER_ENDS = ("_HERE", "PLACEHOLDER", "_ME")
_FENCE = r"(?sm)^[ \t]*(```|~~~).*?^[ \t]*\1[ \t]*$"
_CODE = r"(?si)``[^\n]*?``|`[^`\n]*`|<code\b.*?</code>|<pre\b.*?</pre>"
_QUOTE = r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|「[^」\n]+」"
_TAGS = r"(?si)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->|</?[a-z!][^<>\n]*>"
_ENDS = r"([.!?…][\"'”)]?)\s+|([。！？])"
_NUMBER = r"\b(?=[0-9a-fA-F])(?=[a-fA-F]*\d)[0-9a-fA-F]{5,}\b|\d+(?:[.,]\d+)*"

# --- seeds: common wordings of error pages, notices and filler, over messages in lower case ----------
# A rule is tried only where one of its words stands in the message (one Aho-Corasick scan finds all words).

_S = r"<\*>"
SEEDS: list[tuple[str, str]] = [
    # scripts
    ("script cookie", r"\b(?:enable|enabling|activate|allow|permit|turn on|switch on|requires?|needs?|must have) (?:java ?scripts?|scripts?|cookies)\b|\b(?:java ?script|scripts?|scripting|cookies) (?:is|are|must be|needs? to be|ha(?:s|ve) to be|seems? to be) (?:\w+ )?(?:disabled|off|enabled|required|blocked|allowed|turned off|switched off|missing|not (?:available|supported|allowed))\b|\bwith (?:java ?)?scripts? enabled\b"),
    ("browser", r"\b(?:your|this|the) browser (?:does not|doesn't|cannot|can't|is too old|is not supported|refuses)\b"),
    ("script cookie", r"\b(?:aktivieren|erlauben) sie (?:bitte )?(?:java ?script|cookies)\b|\bwird java ?script benötigt\b|\bjava ?script (?:ist deaktiviert|muss aktiviert)|\b(?:activer|autoriser|activez|autorisez) java ?script\b|\b(?:exige|nécessite|requiert) java ?script\b|\bjava ?script est désactivé"),
    ("script cookie", r"\b(?:active|activar|habilite|habilitar|permita|permitir) java ?script\b|\b(?:necesita|requiere|exige) java ?script\b|\bjava ?script está (?:desactivado|bloqueado)"),
    # errors
    ("http/", rf"^http/{_S} {_S}"),
    ("server: content- retry-after: connection: x- via:", r"^(?:server|content-length|content-type|retry-after|connection|via|x-[a-z-]+): ?\S+(?: \S+)?$"),
    ("error erreur fehler", rf"^(?:#+ )?(?:error|erreur|fehler) ?(?:code )?{_S}|^\w*error: |\ban error (?:has )?occurred\b|\binternal server error\b|\bune erreur (?:est survenue|s'est produite)\b|\b(?:ein fehler aufgetreten|ist ein fehler)\b|\bse ha producido un error\b"),
    ("exception", r"^\w*exception: "),
    ("not found", r"^[^\w]*(?:#+ )?(?:<\*>[ :-]+)?(?:page |file )?not found\W*$"),
    ("forbidden gateway unavailable unauthori request gone", rf"^(?:#+ )?(?:{_S}[ :-]+)?(?:forbidden|bad gateway|bad request|service (?:temporarily )?unavailable|gateway time-?out|too many requests|unauthori[sz]ed|{_S} gone)\W*$|\bunavailable right now\b|\btemporarily unavailable\b"),
    ("denied permission", r"\b(?:access|permission) denied\b|\b(?:do|does) not have permission\b"),
    ("oops wrong try again", r"^oops\b|\bsomething went wrong\b|^(?:please )?try again\b"),
    ("too many", r"\btoo many (?:attempts|requests)\b"),
    ("human robot", r"\b(?:you are|you're|are you) (?:a )?(?:human|not a robot)\b"),
    ("session sign log", r"\bsession has expired\b|^(?:please )?sign in (?:again )?to\b|^(?:please )?log in\b"),
    ("available", r"\bno longer available\b"),
    ("find", r"\b(?:can't|cannot|could not|couldn't) find (?:that|the|this) page\b"),
    ("be found be loaded be shown be displayed be reached be opened", r"\b(?:could not|couldn't|cannot|can't) be (?:found|loaded|shown|displayed|reached|opened)\b"),
    ("exist", r"\b(?:does not|doesn't|no longer) exists?\b"),
    ("failed to", r"\bfailed to load\b"),
    ("timed out expired taken down blocked removed deleted moved", r"^(?:the|this|that|your) [\w ]{0,30}\b(?:timed out|expired|taken down)\b|^(?:the|this|that|your) (?:page|item|list|post|content|request|link)\b[\w ]{0,20} (?:was|were|has been|have been|is) (?:blocked|removed|deleted|moved)\b|\bmay have been (?:moved|removed|deleted)\b"),
    ("traceback", r"^traceback \(most recent"),
    ("warning fatal critical panic uncaught", r"^(?:warning|fatal|critical|panic|uncaught \w+)\b:? .*(?:refused|reset|exceeded|time-?out|timed out|used up|failed|could not|undefined|not found)"),
    ("status code", r"^\{.*\"(?:status|code)\".*\"(?:error|message)\".*\}$"),
    ("introuvable refusé interdit réessay connecter existe expiré pas pu être", r"\bpage introuvable\b|\baccès (?:refusé|interdit)\b|\bréessay(?:er|ez)\b|\bveuillez vous (?:re)?connecter\b|\bn'existe plus\b|\bn'a pas pu être (?:chargée?|affichée?|trouvée?)\b|\bsession a expiré\b"),
    ("gefunden verweigert versuchen melden existiert konnte wurde abgelaufen verfügbar", r"\bnicht gefunden\b|\bzugriff verweigert\b|\bversuchen sie es\b|\bnoch einmal versuchen\b|\bmelden sie sich (?:bitte )?an\b|\bexistiert nicht mehr\b|\bkonnte nicht (?:geladen|gefunden|angezeigt)\b|\bwurde (?:gelöscht|entfernt|gesperrt)\b|\bsitzung ist abgelaufen\b|\bnicht (?:mehr )?verfügbar\b"),
    ("página denegado intent pruebe sesión existe cargar mostrar eliminad bloquead borrad disponible", r"\bno se (?:encuentra|encontró) la página\b|\bacceso denegado\b|\b(?:vuelva a intentar|inténtelo|pruebe más tarde)|\binicie sesión\b|\bya no existe\b|\bno se (?:pudo|ha podido) (?:cargar|mostrar|encontrar)\b|\bsesión ha (?:caducado|expirado)\b|\bha sido (?:eliminad|bloquead|borrad)[ao]\b|\bno está disponible\b"),
    # filler
    ("lorem dolor", r"^lorem\b|\blorem ipsum\b|\bdolor sit amet\b"),
    ("dummy placeholder sample filler goes here", r"\b(?:dummy|placeholder|sample|filler) (?:text|copy|content)\b|\b(?:text|description|title|content|copy) goes here\b"),
    ("add heading title content", r"^add (?:your )?(?:body |more )?(?:copy|text|content)\b|^heading (?:one|two|three)$|^(?:no title|untitled|no content)$"),
    ("blindtext remplissage relleno ejemplo", r"\bblindtext\b|\btexte de remplissage\b|\btexto de (?:relleno|ejemplo)\b"),
    ("todo tbd tba n/a na fixme xx -- ... … __ ?? *** undefined null nan none nil [object", r"^(?:(?:todo|tbd|tba|n/?a|fixme|x{2,}|-{2,}|\.{3}|…|_{2,}|\?{2,}|\*{3,}|undefined|null|nan|none|nil|\[object object\])[.:,;]?(?: |$))+$"),
]
#: The same for Chinese, where messages have no blanks between signs.
SEEDS_ZH: list[tuple[str, str]] = [
    ("script 脚本", r"(?:打开|开启|启用|允许)[^。]{0,6}(?:javascript|脚本)|(?:javascript|脚本)[^。]{0,8}(?:禁用|关闭|不可用)"),
    ("错误 出错 不存在 删除 下架 无法 权限 拒绝 稍后 不可用 登录 失败 过期", r"^错误<\*>|发生错误|出现错误|出错了|(?:页面|内容|列表|条目)[^。]{0,6}(?:不存在|删除|下架|无法访问)|没有(?:访问)?权限|访问被拒绝|稍后(?:再试|重试)|暂时不可用|请(?:先|重新)?登录|(?:加载|打开)失败|会话已过期"),
    ("示例 占位", r"示例(?:文本|文字)|占位"),
]
_KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_PHRASES = ("be ", "too many", "not found", "goes here", "failed to", "taken down", "timed out", "pas pu")


class Seeds:
    """Whether a message has a seed: a word of a rule, then the rule itself, or repeated or typed-along words."""

    def __init__(self):
        import re

        import ahocorasick

        words: dict[str, list[tuple[bool, re.Pattern]]] = {}
        for rules, zh in ((SEEDS, False), (SEEDS_ZH, True)):
            for names, rule in rules:
                pattern = re.compile(rule)
                parts, rest = [p for p in (" " + names).split(" ") if p], []
                while parts:  # phrases of two words stay together
                    two = " ".join(parts[:2])
                    take = 2 if len(parts) > 1 and two.startswith(_PHRASES) else 1
                    rest.append(" ".join(parts[:take]))
                    parts = parts[take:]
                for w in rest:
                    words.setdefault(" ".join(w) if zh and not w.isascii() else w, []).append((zh, pattern))
        self.scan = ahocorasick.Automaton()
        for w, rules in words.items():
            self.scan.add_word(w, rules)
        self.scan.make_automaton()

    def __call__(self, m: str) -> bool:
        tried = set()
        for _, rules in self.scan.iter(m):
            for zh, rule in rules:
                if rule not in tried:
                    tried.add(rule)
                    if rule.search(m.replace(" ", "") if zh else m):
                        return True
        w = m.split(" ", 3)
        if len(w) > 1 and len(w[0]) > 2:
            bare = [x.strip(".,;:!?") for x in w[:3]]
            if (len(w) > 2 and bare[0] == bare[1] == bare[2]) or (any(bare[0] in k for k in _KEYS) and any(bare[1] in k for k in _KEYS) and len(bare[1]) > 2):
                every = {x.strip(".,;:!?") for x in m.split(" ")}
                return len(every) == 1 or all(len(x) > 2 and any(all(x[i : i + 3] in k for i in range(len(x) - 2)) for k in _KEYS) for x in every)
        return False


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """parts (m, n) to parts (m, n, seed)."""
    seeds = Seeds()
    for b in batches:
        p = b.column("p")
        at, end = p.offsets[0].as_py(), p.offsets[len(p)].as_py()
        inner = p.values.slice(at, end - at)
        m = inner.field("m")
        flags = pa.array([seeds(x) for x in m.to_pylist()], pa.bool_())
        parts = pa.ListArray.from_arrays(pa.array(p.offsets.to_numpy() - at), pa.StructArray.from_arrays([m, inner.field("n"), flags], ["m", "n", "seed"]))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row_no", "k", "code", "slot")), parts], names=["row_no", "k", "code", "slot", "parts"])


def _at(tokens: Column, i: int) -> Column:
    return F.get(tokens, F.lit(i))


def read_messages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row_no, k, slot, total, parts): the messages of every record, kept.

    slot: a placeholder stands outside code and quotations. total: characters
    without blanks. parts: each message m (masked, lower case), its characters
    n, and whether it has a seed of its own.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    t = F.col("t")
    held = lambda c: c.rlike(PLACEHOLDER) | ((c.contains(PLACEHOLDER_ENDS[0]) | c.contains(PLACEHOLDER_ENDS[1]) | c.contains(PLACEHOLDER_ENDS[2])) & c.rlike(PLACEHOLDER_WORDS))
    size = lambda c: F.length(F.replace(c, F.lit(" "), F.lit("")))
    rows = rows.select("k", F.coalesce(t, F.lit("")).alias("t"))
    fenced = t.contains("```") | t.contains("~~~")
    rows = rows.select("k", "t", F.when(fenced, F.regexp_replace(t, _FENCE, "\n")).otherwise(t).alias("b"))
    b = F.col("b")
    rows = rows.select("k", F.when(fenced, size(F.replace(t, F.lit("\n"), F.lit(""))) - size(F.replace(b, F.lit("\n"), F.lit("")))).otherwise(0).alias("code"), F.when(b.rlike("`|<(?i:code|pre)"), F.regexp_replace(b, _CODE, " ⟨code⟩ ")).otherwise(b).alias("b"))
    rows = rows.select("k", "code", F.when(held(b), held(F.regexp_replace(b, _QUOTE, " "))).otherwise(False).alias("slot"), F.when(b.contains("<"), F.regexp_replace(b, _TAGS, "\n")).otherwise(b).alias("b"))
    strip = lambda x: F.btrim(x, F.lit("*_ \t\r　 "))
    lines = F.filter(F.transform(F.split("b", "\n"), lambda x: F.when(x.startswith("> "), strip(F.substring(x, 3, 2**31 - 1))).otherwise(strip(x))), lambda x: x != "")
    whole = lambda x: x.startswith("{") | x.startswith("[") | x.startswith("|") | x.startswith("Lorem") | x.startswith("lorem") | x.startswith("LOREM")
    parts = F.flatten(F.transform(lines, lambda x: F.when(whole(x), F.array(x)).otherwise(F.filter(F.split(F.regexp_replace(x, _ENDS, "$1$2\x01"), "\x01"), lambda y: y != ""))))

    # one step at a time: a lambda evaluates an expression as often as it names it
    rows = rows.select(F.monotonically_increasing_id().alias("row_no"), "k", "code", "slot", parts.alias("p"))
    rows = rows.select("row_no", "k", "code", "slot", "p", F.transform("p", lambda x: size(x).cast("bigint")).alias("n"))
    unsaid = lambda x: F.when((x.contains('"') | x.contains("“") | x.contains("„") | x.contains("「")) & ~whole(x) & ~x.startswith("File "), F.regexp_replace(x, _QUOTE, " ⟨quote⟩ ")).otherwise(x)
    m = F.transform(F.transform("p", unsaid), lambda x: F.lower(F.regexp_replace(x, _NUMBER, SLOT)))
    m = F.transform(m, lambda x: F.when(F.octet_length(x) > F.length(x), F.regexp_replace(x, r"(\p{IsHan})", " $1 ")).otherwise(x))
    m = F.transform(m, lambda x: F.trim(F.when(x.contains("  ") | x.contains("\t"), F.regexp_replace(x, r"\s+", " ")).otherwise(x)))
    rows = rows.select("row_no", "k", "code", "slot", F.arrays_zip(m.alias("m"), F.col("n")).alias("p"))
    kind = docs.schema[key].dataType.simpleString()
    rows = rows.mapInArrow(_seeded, f"row_no bigint, k {kind}, code int, slot boolean, parts array<struct<m: string, n: bigint, seed: boolean>>")
    total = F.col("code") + F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    return scratch.keep(rows.select("row_no", "k", "slot", total.alias("total"), "parts"), "messages")


def path(tokens: Column) -> Column:
    """Where a message goes in the tree: number of tokens, first and last token."""
    return F.xxhash64(F.size(tokens), _at(tokens, 0), F.element_at(tokens, -1))


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of records to the leaves of this task, with a slot wherever their tokens differ."""
    leaves: dict[tuple, list] = {}

    def out():
        v = list(leaves.values())
        columns = [[k[1] for k in leaves], [k[2] for k in leaves], pa.array([k[0] for k in leaves], pa.int32()), *([x[i] for x in v] for i in range(6))]
        leaves.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["first", "last", "size", "w", "messages", "lo", "hi", "seeded", "among"])

    for b in batches:
        for no, total, ms, ns, seeds in zip(*(b.column(c).to_pylist() for c in ("row_no", "total", "m", "n", "seed"))):
            bad = sum(n for n, s in zip(ns, seeds) if s)
            for m, n, seed in zip(ms, ns, seeds):
                w = m.split(" ")
                size = len(w)
                among = (bad - n if seed else bad) / max(total - n, 1) if bad else 0.0
                got = leaves.get(key := (size, w[0], w[-1]))
                if got is None:
                    leaves[key] = [w[:DEPTH], 1, no, no, int(seed), among]
                    continue
                t = got[0]
                if size > 2 and t != w:
                    for i in range(1, min(size, DEPTH)):
                        if t[i] != w[i]:
                            t[i] = SLOT
                got[1] += 1
                got[3] = no
                got[4] += seed
                got[5] += among
        if len(leaves) > HELD:
            yield out()
    if leaves:
        yield out()


def mine_templates(read: DataFrame) -> DataFrame:
    """(leaf, template, messages, several, seeded, among): each template with its occurrences, kept.

    messages: occurrences; several: they are in more than one record; seeded:
    the part of them with a seed of their own; among: the mean part of the
    other text of their records that has seeds.
    """
    rows = read.select("row_no", "total", F.col("parts.m").alias("m"), F.col("parts.n").alias("n"), F.col("parts.seed").alias("seed"))
    part = rows.mapInArrow(_mine, "first string, last string, size int, w array<string>, messages bigint, lo bigint, hi bigint, seeded bigint, among double")
    ends = [f(_at(F.col("w"), i)).alias(f"{n}{i}") for i in range(1, DEPTH) for n, f in (("a", F.min), ("z", F.max))]
    found = part.groupBy(F.xxhash64("size", "first", "last").alias("leaf")).agg(
        F.sum("messages").alias("messages"), (F.min("lo") != F.max("hi")).alias("several"), (F.sum("seeded") / F.sum("messages")).alias("seeded"), (F.sum("among") / F.sum("messages")).alias("among"),
        F.min("size").alias("size"), F.min("first").alias("first"), F.min("last").alias("last"), *ends,
    )
    kept = [F.when(F.col("size") > i, F.when(F.col(f"a{i}") == F.col(f"z{i}"), F.col(f"a{i}")).otherwise(SLOT)) for i in range(1, DEPTH)]
    tail = F.when(F.col("size") > DEPTH, F.concat(F.lit("… "), F.col("last")))
    return scratch.keep(found.select("leaf", F.concat_ws(" ", "first", *kept, tail).alias("template"), "messages", "several", "seeded", "among"), "templates")


# --- the model -------------------------------------------------------------------


def features(template: str) -> list[int]:
    """Hashed words, pairs and triples of words, and stems of a template; slots are words."""
    words = ["^", *(w.strip(".,;:!?()'\"") or w for w in template.split(" ")), "$"]
    names = {*words[1:-1], *(" ".join(p) for p in zip(words, words[1:])), *(" ".join(p) for p in zip(words, words[1:], words[2:])), *("~" + w[:5] for w in words if len(w) > 5)}
    return [zlib.crc32(n.encode()) % WIDTH for n in sorted(names) if n != SLOT]


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all texts."""
    got = [features(t) for t in texts]
    return np.repeat(np.arange(len(got)), [len(g) for g in got]), np.fromiter((f for g in got for f in g), np.int64, sum(map(len, got)))


def fit(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic model (the last is the bias); both labels weigh the same."""
    row, col = _flat(texts)
    size = np.maximum(np.bincount(row, minlength=len(texts)), 1)
    val = 1 / np.sqrt(size)[row]
    w, seen, bias = np.zeros(WIDTH), np.full(WIDTH, 1e-8), 0.0
    share = np.where(labels, 0.5 / max(labels.sum(), 1), 0.5 / max((~labels).sum(), 1))
    for _ in range(PASSES):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col] * val, minlength=len(texts)) + bias, -30, 30)))
        err = (p - labels) * share
        g = np.bincount(col, weights=err[row] * val, minlength=WIDTH) + RIDGE * w
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
        bias -= 0.5 * err.sum()
    return np.r_[w, bias]


def chances(texts: list[str], w: np.ndarray) -> np.ndarray:
    """Chance that each template is residue; 0 for one with fewer than two words of its own."""
    row, col = _flat(texts)
    size = np.maximum(np.bincount(row, minlength=len(texts)), 1)
    s = np.bincount(row, weights=w[col], minlength=len(texts)) / np.sqrt(size) + w[-1] if len(texts) else np.zeros(0)
    told = np.array([sum(any(c.isalpha() for c in w) for w in t.split(" ") if w != SLOT) > 1 for t in texts], bool)
    return np.where(told, 1 / (1 + np.exp(-np.clip(s, -30, 30))), 0.0)


def classify_templates(mined: DataFrame) -> DataFrame:
    """(leaf, template, messages, verdict): seed, model, margin or null, for every template.

    seed: half of the occurrences or more have a seed of their own. model: the
    text model says so; two models are fitted, each on one half of the labelled
    sample (by hash of the leaf), and a template is judged by the half it is
    not in. margin: see TIMES and AMONG. Unlabelled for the fit are templates
    that stand among seeds.
    """
    half = F.pmod("leaf", F.lit(2)).cast("int")
    label = F.when(F.col("seeded") >= 0.5, 1).when((F.col("seeded") == 0) & (F.col("among") < 0.25), 0)
    pool = mined.select("template", half.alias("half"), label.alias("label"), F.xxhash64("leaf").alias("h")).where("label IS NOT NULL")
    got = pool.where("label = 1").orderBy("h").limit(SAMPLE).unionByName(pool.where("label = 0").orderBy("h").limit(SAMPLE)).toArrow()
    texts, halves, labels = got.column("template").to_pylist(), got.column("half").to_numpy(), got.column("label").to_numpy() == 1
    models: list[np.ndarray] | None = []
    for h in (0, 1):
        mine = np.flatnonzero(halves != h)
        if min(labels[mine].sum(), (~labels[mine]).sum()) < ENOUGH:
            models = None
            break
        order = mine[np.argsort(np.array(texts, dtype=object)[mine], kind="stable")]
        models.append(fit([texts[i] for i in order], labels[order]).astype(np.float32))
    if models is None:
        judged = mined.withColumn("p", F.lit(0.0))
    else:
        shared = mined.sparkSession.sparkContext.broadcast(models)  # two vectors of WIDTH numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, half = b.column("template").to_pylist(), b.column("leaf").to_numpy() % 2
                p = np.zeros(len(texts))
                for h in (0, 1):
                    at = np.flatnonzero(half == h)
                    p[at] = chances([texts[i] for i in at], shared.value[h])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "p"])

        judged = mined.mapInArrow(run, "leaf bigint, template string, messages bigint, several boolean, seeded double, among double, p double")
    verdict = F.when(F.col("seeded") >= 0.5, "seed").when(F.col("p") >= SURE, "model").when(F.col("several") & (F.col("messages") >= TIMES) & (F.col("among") >= AMONG), "margin")
    return judged.select("leaf", "template", "messages", verdict.alias("verdict"))


def template_verdicts(read: DataFrame) -> DataFrame:
    """The templates with a verdict, kept."""
    return scratch.keep(classify_templates(mine_templates(read)).where("verdict IS NOT NULL"), "verdicts")


def residue_records(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, slot, share, residue) of every record with a slot or residue.

    slot: an unfilled placeholder stands outside code and quotations. share:
    the part of its characters (blanks don't count) in error messages, script
    notices, filler and what surrounds them. residue: the record is to be
    excluded, because it has a slot or more than half of it is such text. Null
    and blank texts have neither. Repeated records are judged each.
    """
    read = read_messages(docs, key, text)
    verdicts = template_verdicts(read).select("leaf", "verdict")
    parts = read.select("row_no", F.explode("parts").alias("p")).select("row_no", path(F.split("p.m", " ")).alias("leaf"), "p.n", "p.seed")
    judged = parts.join(verdicts, "leaf", "left").where("seed OR verdict IS NOT NULL")
    hit = judged.groupBy("row_no").agg(F.sum("n").alias("bad"), F.max(F.col("seed") | (F.col("verdict") != "margin")).alias("real"))
    joined = read.select("row_no", "k", "slot", "total").join(hit, "row_no", "left").where("slot OR real")
    bad = F.when(F.col("real"), F.col("bad")).otherwise(0)
    return joined.select(F.col("k").alias(key), "slot", (bad / F.col("total")).alias("share"), (F.col("slot") | F.coalesce(bad * 2 > F.col("total"), F.lit(False))).alias("residue"))
