"""Problem 3: unfilled templates, filler text and error or script notices in the place of content.

Page furniture is cut away first (problem 1); what is left is the body. A body is residue as a whole when its lines are
template tags, filler or notices of errors, missing scripts and gates. A real body is residue when it has unfilled
holes: each delimiter has its own grammar, and a hole counts only where the text around it does not talk about it
(code blocks, inline code, manuals, shells, quoted marks). A text that does so is a tutorial where its holes are dense.
Evidence is taken from each line where the text is; the verdict is made when the lines have their labels.

Cases: null, empty and blank texts are no residue; a record that is furniture only is residue if one of its lines is
residue by itself; repeated records come once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .boilerplate import labelled

#: Grammar of a hole by its delimiters.
HOLES = [
    ("double brace", r"\{\{[\s#/>&]*[\w.\-]+(?:\s*\|\s*[\w.\-: '\"]+)*\s*\}\}"),
    ("block tag", r"\{%-?\s*\w+[^%\n]{0,80}-?%\}"),
    ("server tag", r"<%[=\-#@]?[^%\n]{1,100}%>"),
    ("dollar brace", r"\$\{[\w.\-]+\}"),
    ("hash brace", r"#\{[\w.\-]+\}"),
    ("percent", r"%%?[A-Z][A-Z0-9_]+%%?"),
    ("at signs", r"@@\w+@@"),
    ("underscores", r"\b__[A-Za-z][A-Za-z0-9_]*?__\b"),
    ("dollar", r"\$[a-z_]{2,}\$"),
    ("square", r"\[(?:[A-Z][A-Z0-9_]*(?: [A-Z0-9_]+)*|(?:TODO|TBD|FIXME)\b[^\]\n]{0,120}|(?:[Ii]nsert|[Yy]our|[Aa]dd|[Ee]nter) [^\]\n]{1,120})\]"),
    ("angle", r"<[A-Z][A-Z_]+(?: [A-Z_]+)*>"),
    ("brace", r"(?<![\w${])\{[A-Z][A-Z_]*\}(?!\})"),
    ("crosses", r"\bX{2,}(?:[.,]X{2,})+\b"),
    ("to do", r"\b(?:TODO|FIXME|TBD)\b:?"),
]
HOLE = re.compile("|".join(f"(?:{p})" for _, p in HOLES))

#: Words of a sentence that talks about marks instead of leaving them unfilled.
ABOUT = re.compile(
    r"\b(?:placeholders?|template|templates|manual|syntax|shell|variable|variables|tutorial|documentation|snippet of code|stands for|marks the place|"
    r"names the directory|such as|is written|are written|is replaced|are replaced|expands? to|escaped|quoted)\b|Platzhalter|Vorlage|gabarit|plantilla|marcador|шаблон|заполнител|占位|模板|プレースホルダ|テンプレート",
    re.I,
)
CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`", re.S)
#: More open holes than this for each 100 characters make a text a tutorial, if it talks about holes or shows them in code.
TUTORIAL_DENSITY = 2.0

#: Syllables of the pseudo-Latin filler (fixed values); a word of it is a chain of them.
LATIN = re.compile(
    r"(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|"
    r"lor|ips|dol|am|con|sec|te|tur|adi|pis|cin|eli|eius|mod|tem|por|inc|idi|id|dunt|unt|la|bor|re|mag|na|ali|qua|en|im|min|ven|iam|nos|tru|d|exer|ci|ta|tion)+",
    re.I,
)
WORD = re.compile(r"[^\W\d_]+")
FILLER = re.compile(
    r"(?:(?:asdf|qwer|test|xxx+|text|blah|foo|bar|lorem|dummy)\b[\s,.]*){2,}.*|(?:sample|dummy|filler|example) text\b.*|your (?:title|subtitle|text|headline|content)\b.*|"
    r"write something about yourself.*|this is an example page\b.*|replace (?:it|this) with your own.*|hello world!?.*",
    re.I | re.S,
)
EMPTY_VALUES = re.compile(r"(?:\[object Object\]|undefined|null|NaN|None|true|false|by|minutes to read|\W)+", re.I)

#: Notices in the place of a page: errors, missing pages, scripts, gates, waiting rooms.
NOTICES = re.compile(
    r"""
    (?:error\s+)?\b[45]\d\d\b\s*(?:not\ found|forbidden|bad\ gateway|service|gateway|internal|too\ many|unauthorized|gone|error|bad\ request|method|temporarily).*
    |error\s+[45]\d\d\b.*|fehler\s+[45]\d\d\b.*
    |the\ requested\ (?:path|url|page|resource).*|upstream\ .*|retry\ after\ .*|nginx.*|apache/.*
    |something\ went\ wrong.*|an\ error\ (?:has\ )?occurred.*|error\ establishing\ .*
    |(?:sorry,\ )?(?:we\ (?:could\ not|couldn't|can't|cannot)\ find|the\ page\ you).*|(?:page|file|document|site)\ not\ found.*|this\ page\ (?:has\ been|no\ longer|does\ not|is\ not).*|try\ the\ search\ box.*
    |you\ do(?:\ not|n't)\ have\ permission.*|access\ (?:is\ )?denied.*|your\ (?:request|access)\ (?:was|has\ been)\ (?:blocked|denied).*|your\ session\ has\ expired.*
    |(?:fatal\ error|warning|notice|parse\ error|uncaught\ \w+|exception|traceback|stack\ trace|\w*(?:Error|Exception))\b\s*[:(].*|\#\d+\ .*|file\ ".*",\ line\ .*|at\ [\w.$<>]+\(.*\)
    |please\ (?:wait|enable|turn|allow|activate|verify|complete|reload|sign\ in).*|checking\ (?:your|if).*|verifying\ .*|(?:ray|reference|request|incident|ticket)\ ?(?:id)?:?\ [0-9a-f]+.*|[0-9a-f]{8,}
    |(?:java)?scripts?\ (?:is|are|must|required).*|loading\b.*(?:\.\.\.|…).*|if\ nothing\ happens.*
    |maintenance\ in\ progress.*|the\ domain\ .*(?:parked|for\ sale).*
    |too\ many\ requests.*
    |(?:die\ )?(?:seite|datei)\ (?:wurde\ )?nicht\ (?:gefunden|vorhanden).*|die\ adresse\ .*\ existiert\ nicht.*|fehlercode.*|zugriff\ verweigert.*
    |page\ (?:introuvable|non\ trouvée).*|la\ page\ .*(?:supprimée|n['’]existe).*|erreur\ \d+.*|code\ d['’]erreur.*|accès\ refusé.*
    |página\ no\ (?:encontrada|disponible).*|no\ existe\ /.*|error\ \d+.*|acceso\ denegado.*
    |страница\ не\ найдена.*|код\ ошибки.*|доступ\ запрещ.*|ошибка\ \d+.*
    |(?:页面|网页|頁面)(?:不存在|未找到|找不到).*|错误代码.*|访问被拒绝.*
    |ページが見つかりません.*|コード[0-9a-f]+|エラー.*|アクセス(?:が)?拒否.*
    |पृष्ठ\ नहीं\ मिला.*|त्रुटि.*|कोड\ .*
    |(?:لم\ يتم\ العثور|الصفحة\ غير\ موجودة).*|رمز\ الخطأ.*
    |ไม่พบหน้า.*|รหัส.*
    """,
    re.I | re.X,
)
#: Notices known by what stands further in, tried where one of their words stands.
LATER = re.compile(
    r"""
    .*"(?:status|error|code)"\s*:\s*.*
    |.*could\ not\ be\ (?:loaded|found|displayed|shown)\.?|.*cannot\ be\ shown\.?
    |.*\b(?:enable|requires?|needs?|allow|support)\ (?:java)?scripts?\b.*
    |.*(?:under|for)\ (?:maintenance|construction)\.?|.*will\ be\ back\ .*|.*\bdomain\ is\ (?:parked|for\ sale).*
    |.*\byou\ are\ (?:human|not\ a\ robot)\b.*|.*\bto\ continue\ reading\.?
    |.*aktivieren\ sie\ (?:bitte\ )?javascript.*
    |.*(?:activer|activez)\ javascript.*
    |.*activar\ javascript.*
    |.*включите\ javascript.*
    |.*启用\s?javascript.*
    |.*(?:スクリプト|javascript)を有効に.*
    |.*(?:javascript|स्क्रिप्ट).*(?:चालू|सक्षम).*
    |.*(?:تفعيل|تمكين)\ javascript.*|.*javascript.*(?:تفعيل|تمكين).*
    |.*เปิด(?:ใช้(?:งาน)?)?\ ?javascript.*
    """,
    re.I | re.X,
)
LATER_WORDS = (
    "script", "जावास्क्रिप्ट", "स्क्रिप्ट", "スクリプト", "could not be", "cannot be", "maintenance", "construction", "will be back", "domain",
    "you are", "to continue", "status", "error", "code",
)
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")


def _is_notice(sentence: str) -> bool:
    if NOTICES.fullmatch(sentence):
        return True
    low = sentence.lower()
    for word in LATER_WORDS:
        if word in low:
            return LATER.fullmatch(sentence) is not None
    return False


def _notice(line: str) -> bool:
    """Whether the first sentence of a line and at least half of all are notices."""
    first = SENTENCE.search(line)
    if first is None:
        return _is_notice(line)
    if not _is_notice(line[: first.start()]):
        return False
    sentences = SENTENCE.split(line)
    return sum(map(_is_notice, sentences)) * 2 >= len(sentences)


def _latin(word: str) -> bool:
    """Whether a word is a chain of filler syllables; runs of letters longer than any word are none, and would be slow to try."""
    return len(word) <= 40 and LATIN.fullmatch(word) is not None


def _filler(line: str) -> bool:
    if line.isascii():
        words = line.split(None, 5)[:5]
        if len(words) >= 4 and sum(_latin(w.strip(".,;:!?")) for w in words) >= len(words) - 1:
            words = WORD.findall(line)
            if sum(len(w) for w in words if _latin(w)) > 0.9 * sum(map(len, words)):
                return True
    return FILLER.fullmatch(line) is not None


def _whole_line(line: str) -> bool:
    """Whether a line of the body is residue by itself."""
    if _filler(line) or EMPTY_VALUES.fullmatch(line) or _notice(line):
        return True
    if not may_have_hole(line):
        return False
    rest, holes = HOLE.subn("", line)
    return holes > 0 and (len(WORD.findall(rest)) <= 4 * holes or line.startswith("TODO"))


def _sentence(text: str, start: int, end: int) -> str:
    a = max(text.rfind(". ", 0, start), text.rfind("\n", 0, start)) + 1
    b = [x for x in (text.find(". ", end), text.find("\n", end)) if x >= 0]
    return text[a : min(b) if b else len(text)]


#: Without one of these a text has no hole.
HOLE_MARKS = ("{", "[", "<", "%", "$", "@", "_", "#", "XX", "TODO", "TBD", "FIXME")
_KNOWN: dict[str, int] = {}


def may_have_hole(text: str) -> bool:
    for mark in HOLE_MARKS:
        if mark in text:
            return True
    return False


def evidence(text: str, stripped: list[str]) -> list[int]:
    """Two numbers for each non-blank line: its size, negative for residue by itself, and 2 x open holes + 1 if holes are
    shown in it. What stands in code blocks is shown."""
    out = []
    clean = shown_code = None
    if may_have_hole(text):
        clean = text
        if "`" in text:
            spans = [m.span() for m in CODE.finditer(text) if HOLE.search(m[0])]
            shown_code = {text.count("\n", 0, a) for a, _ in spans}
            clean = CODE.sub(lambda m: "\n" * m[0].count("\n") or " ", text)
        clean = clean.split("\n")
    numbers = [i for i, x in enumerate(text.split("\n")) if x.strip()] if clean else stripped
    for i, s in zip(numbers, stripped):
        size = _KNOWN.get(s)
        if size is None:
            size = -len(s) if _whole_line(s) else len(s)
            if len(s) < 60:
                if len(_KNOWN) > 100_000:
                    _KNOWN.clear()
                _KNOWN[s] = size
        marks = 0
        if clean and may_have_hole(clean[i]):
            line = clean[i]
            for m in HOLE.finditer(line):
                if ABOUT.search(_sentence(line, m.start(), m.end())):
                    marks |= 1
                else:
                    marks += 2
        if shown_code and i in shown_code:
            marks |= 1
        out += (size, marks)
    return out


def judge(numbers: list[int], furniture: list[bool]) -> bool:
    """Whether a page is residue, from the evidence of its lines and which of them are furniture."""
    sizes, marks = numbers[::2], numbers[1::2]
    body = [k for k, x in enumerate(furniture) if not x]
    if not body:
        return any(x < 0 for x in sizes)  # residue that repeats so often that it counts as furniture
    size = sum(abs(sizes[k]) for k in body)
    good = sum(sizes[k] for k in body if sizes[k] > 0)
    if good <= (LEAST_SHARE + SHORT_SHARE * HALF_SIZE / (HALF_SIZE + size)) * size:
        return True
    holes = sum(marks[k] >> 1 for k in body)
    # holes of a text that shows some are its subject where they are dense
    shown = any(marks[k] & 1 for k in body)
    return holes > 0 and not (shown and holes * 100 > TUTORIAL_DENSITY * size)


#: A body is residue as a whole if at most this share of it is anything else; a short one may have more loose words.
LEAST_SHARE, SHORT_SHARE, HALF_SIZE = 0.35, 0.3, 400


def residue_records(df: DataFrame) -> DataFrame:
    """(id) of the records of (id, text[, site]) that are residue."""
    return labelled(df, evidence, judge).where("judged").select("id")
