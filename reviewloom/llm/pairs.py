"""Problem 2: questions whose answer is useless, with the kind of defect."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import at, map_batches
from .lookalike import consistent_form
from .structure import is_shell
from .truncation import CONTEXTS, SETTLED, SETTLED_NAMES, UNKNOWN_ODDS, Model, log_odds, settle_all, settled

DEFECTS = ("empty", "refusal", "copy", "truncated", "language")

#: A tile must be so long, in letters and digits; and tiles must cover so much of the answer and of the question.
TILE_HAN, TILE_OTHER = 6, 12
COVER_ANSWER, COVER_QUESTION = 0.8, 0.35

# Refusal grammars: a refused act (a negated ability or will) and its object, what the answer was to do, in one sentence.
# What a shop can't do for a buyer, or a product for its user, has another object and is no refusal.
_ZH_NOT = "无法|不能|没法|不便|不予|没有办法|没办法|不打算|不愿|不想|暂不支持|不支持|拒绝|恕不|恕难|恕我|不会|不可以|难以|不方便|做不到|办不到|无权"
_ZH_TASK = "判断|分析|作答|回答|回复|回应|评价|讨论|生成|翻译|总结|概括|提取|撰写|编写|输出|评论|发表"
_ZH_THING = "请求|要求|任务|问题|内容|文本|话题|评论|信息|结果|答案|回复|意见|服务|关键词|情感|摘要|译文|结论|建议|此类|这类"
_ZH_DO = "完成|处理|提供|给出|协助|满足|执行|接受|继续|涉及|帮助|帮忙|支持"
_REFUSAL_ZH = regex.compile(
    rf"(?:不支持|拒绝|谢绝)(?:{_ZH_THING}|该|这)|(?:{_ZH_NOT})[^。！？!?，,；;]{{0,10}}?(?:{_ZH_TASK}|(?:{_ZH_DO})[^。！？!?，,；;]{{0,10}}?(?:{_ZH_THING}|您|你)|(?:{_ZH_DO})(?=[。！!，,]|$))"
    rf"|(?:{_ZH_THING}|{_ZH_TASK}|{_ZH_DO})[^。！？，,]{{0,10}}(?:超出|不在|违反|超过)[^。！？，,]{{0,8}}(?:能力|范围|规范|政策|准则|权限)|(?:超出|超过|不在)[^。！？，,]{{0,4}}(?:我|我们|助手|模型)?的?(?:能力|处理|服务)[^。！？，,]{{0,2}}范围|(?:文本|内容|请求|要求|任务)[^。！？，,]{{0,4}}(?:不予|做不到|办不到)"
    r"|我[^。！？，,]{0,6}(?:做不到|办不到|帮不了|帮不上|无能为力)|恕不(?:奉告|作答|回答|从命)|恕难(?:从命|奉告|作答)|恕我(?:无法|不能|直言不能)|爱莫能助|无可奉告"
)
#: A condition says when something would fail; the sentence then declines nothing. So does a report of what others declined.
_NO_REFUSAL_ZH = regex.compile(r"如果|如若|若是|若您|若仍|假如|要是|仍然|(?:客服|卖家|商家|店家|买家|用户|他们?|她们?)[^，,。]{0,6}(?:拒绝|不予|不愿|无法|不能|不会|不肯)|(?:说明书|产品|商品|屏幕|系统|机器|设备)[^，,。]{0,6}(?:无法|不能|不支持|难以)")
_EN_VERB = r"(?:help|assist|judge|answer|provid\w*|process\w*|complet\w*|analy[sz]\w*|comply|respond\w*|fulfil\w*|do (?:that|this|so)|discuss\w*|generat\w*|translat\w*|summari[sz]\w*|support (?:this|that|such)|reply\w*|evaluat\w*|extract\w*|engage|continue|give (?:an?|any) (?:answer|opinion|assessment)|write|share)"
_EN_NOT = r"(?:can(?:no|'|’)t|can not|could(?:n't|n’t| not)|unable|not able|won(?:'|’)t|will not|must decline|decline|declining|refuse|not going|rather not|do(?:n't|n’t| not) feel comfortable|not comfortable|not (?:in a position|allowed|permitted)|have to decline)"
_REFUSAL_EN = regex.compile(
    rf"\bI(?:'m| am|’m|'d|’d| would| do)?\b[^.!?]{{0,20}}\b{_EN_NOT}\b[^.!?]{{0,24}}\b{_EN_VERB}\b|\bI\b[^.!?]{{0,12}}\b(?:decline|refuse)\b|\b(?:unable|not able) to {_EN_VERB}\b"
    rf"|\b(?:content|request|text|this|it|task|question)\b[^.!?]{{0,20}}\b(?:cannot|can(?:'|’)t|can not|may not) be {_EN_VERB}|\b(?:falls?|is|lies) (?:outside|beyond)\b[^.!?]{{0,30}}\b(?:I|my|me)\b|\bagainst (?:my|the|our) (?:guidelines|policy|policies|rules)",
    regex.I,
)
_NO_REFUSAL_EN = regex.compile(r"\bif\b|\b(?:seller|buyer|shop|customer|support|they|he|she)\b[^.!?]{0,12}\b(?:can(?:no|'|’)t|could|would|refused?|declined?|won)", regex.I)
#: A shop's "we" is about its goods unless the object is the request itself.
_WE = regex.compile(r"\bwe\b(?![^.!?]{0,40}\b(?:request|question|content|text|task)\b)", regex.I)
_FR_VERB = r"(?:répondre|aider|traiter|analyser|fournir|traduire|résumer|juger|évaluer|accéder|donner suite|satisfaire|assister|effectuer|commenter|générer|rédiger|continuer|faire (?:cela|ça))"
_REFUSAL_FR = regex.compile(
    rf"\bje\s+(?:ne\s+|n['’])(?:le\s+)?(?:peux|puis|saurais|pourrai|veux|suis|souhaite)\b[^.!?]{{0,30}}\b{_FR_VERB}|\bje ne (?:peux|puis) pas vous\b|il m['’]est impossible d|\bje (?:refuse|décline|dois (?:refuser|décliner))\b|dans l['’]incapacité d|\bje suis (?:incapable|désolée?)[^.!?]{{0,30}}\b(?:ne (?:peux|puis)|impossible|{_FR_VERB})|(?:cette|votre) (?:demande|requête)[^.!?]{{0,20}}ne (?:peut|saurait) être",
    regex.I,
)
_RU_VERB = r"(?:помочь|помогать|ответить|отвечать|выполнить|обработать|предоставить|перевести|оценить|оценивать|проанализировать|анализировать|обсуждать|написать|дать ответ|комментировать|продолжить|сделать это)"
_REFUSAL_RU = regex.compile(rf"(?:не\s+(?:могу|можем|смогу|сможем|буду|в\s+состоянии|в\s+силах|имею\s+права)|невозможно)[^.!?]{{0,40}}{_RU_VERB}|(?:вынужден[аы]?|должен|должна)\s+отказать|отказываюсь|(?:извините|простите|к сожалению)[^.!?]{{0,20}}не\s+(?:могу|смогу)", regex.I)
#: An apology and a no, and nothing else.
_BARE_REFUSAL = regex.compile(r"^\W*(?:(?:i['’]?m |so |very )*sorry|apologies|désolée?|pardon|извините|простите|很?抱歉|对不起|不好意思)\W{1,3}(?:but\s+|mais\s+|но\s+)?(?:no|non|нет|不行|不可以|不能)\W*$", regex.I)
_SENTENCE = regex.compile(r"(?<=[。！？!?;；\n])|(?<=\.)\s+")
_HOLDS_OBJECT = regex.compile(r'[{\[]\s*["\[{]')

# Names of languages a translation may be asked into.
TARGETS = {
    "en": "英文|英语|english|inglés|anglais|английск",
    "zh": "中文|汉语|简体|繁体|chinese|chinois|китайск",
    "fr": "法文|法语|french|français|французск",
    "ru": "俄文|俄语|russian|russe|русск",
    "es": "西班牙文|西班牙语|spanish|español|espagnol|испанск",
    "de": "德文|德语|german|deutsch|allemand|немецк",
    "ja": "日文|日语|japanese|日本語|japonais|японск",
    "ko": "韩文|韩语|korean|한국어|coréen|корейск",
}
_INTO = {k: regex.compile(rf"(?:译成|翻译成|翻译为|翻成|译为|into|to|in|en|на)\s*(?:{v})|(?:{v})(?:翻译|译文|translation)", regex.I) for k, v in TARGETS.items()}
_ASKS_TRANSLATION = regex.compile("翻译|译成|译为|译文|translat|traduc|traduis|перевед|перевод", regex.I)
# Articles, pronouns, prepositions, conjunctions and auxiliaries of languages of the Latin alphabet. A word
# of several languages counts for each by its share.
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for with from as is are was were be been has have had do does did will would can could not no it its this that these those i you he she we they my your his her our their which who what when where there than then so if very just also",
    "es": "el la los las un una unos unas y o pero de del al en con por para sin sobre es son era fue ha han hay no se su sus lo le les me te nos que como cuando donde muy más también este esta esto ese esa eso mi tu ya si porque todo",
    "fr": "le la les un une des et ou mais de du au aux en dans avec par pour sans sur est sont était a ont ne pas se sa son ses ce cette ces il elle ils elles je tu nous vous on que qui dont où très plus aussi leur mon ma mes votre notre y si comme été cet",
    "de": "der die das den dem des ein eine einen einem einer und oder aber von zu zum zur im in mit auf für aus bei nach ist sind war waren hat haben nicht kein keine sich es er sie wir ihr ich mein sein auch sehr noch als wie wenn dass wurde über",
    "pt": "o a os as um uma e ou mas de do da dos das em no na nos nas com por para sem é são era foi tem não se seu sua ao à que como quando muito mais também este esta isso eu você nós já bem foram",
    "it": "il lo la gli le un uno una e o ma di del della dei delle da dal in nel nella con per senza su è sono era ha hanno non si suo sua che come quando molto più anche questo questa io tu noi loro ci già alla al",
}
_HELD_BY: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _HELD_BY.setdefault(_word, []).append(_language)
#: Signs that only one of these languages has.
_OWN_SIGNS = {"es": regex.compile("[ñ¿¡]"), "de": regex.compile("ß"), "pt": regex.compile("[ãõ]"), "fr": regex.compile("[œêûîôâù]|\\b[cdjlmnst]['’](?=\\p{L})|qu['’]", regex.I)}
_SCRIPTS = {"han": r"\p{Han}", "kana": r"[\p{Hiragana}\p{Katakana}]", "hangul": r"\p{Hangul}", "cyrillic": r"\p{Cyrillic}", "arabic": r"\p{Arabic}", "thai": r"\p{Thai}"}
_SCRIPT = {k: regex.compile(f"{v}+") for k, v in _SCRIPTS.items()}
_OTHER_SCRIPTS = regex.compile(f"[{''.join(v.strip('[]') for k, v in _SCRIPTS.items() if k != 'han')}]")
_HAS_LETTER = regex.compile(r"\p{L}")
_LATIN_WORD = regex.compile(r"(?<![\p{L}\p{N}])\p{Latin}[\p{Latin}\p{M}'’]*(?![\p{N}])")
_ASCII_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z']*(?![0-9])")
_KEY = regex.compile(r'"[^"]{1,40}"\s*:|\*\*[^*\n]{1,20}\*\*\s*[:：]?|```\w*|https?://\S+|\S+@\S+')
_ELIDED = regex.compile(r"^(?:[cdjlmnst]|qu)['’]", regex.I)
_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Each grammar with what makes a sentence none of its refusals. A match lies within a sentence, so one search over the
#: whole answer tells nearly all answers that refuse nothing.
_GRAMMARS = ((_REFUSAL_EN, (_NO_REFUSAL_EN, _WE)), (_REFUSAL_FR, ()), (_REFUSAL_ZH, (_NO_REFUSAL_ZH,)), (_REFUSAL_RU, ()))


def refuses(answer: str) -> bool:
    """Whether a sentence of the answer declines the task and the answer holds no object."""
    if _HOLDS_OBJECT.search(answer):
        return False
    if _BARE_REFUSAL.match(answer):
        return True
    for grammar, exceptions in _GRAMMARS[:2] if answer.isascii() else _GRAMMARS:
        if grammar.search(answer) and any(grammar.search(x) and not any(e.search(x) for e in exceptions) for x in _SENTENCE.split(answer)):
            return True
    return False


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` characters, by doubling: the number of steps grows with the size's logarithm."""
    h, have, done, out = codes + np.uint64(1), 1, 0, None
    while True:
        if size & have:
            out = h if out is None else _joined(out, h, done)
            done += have
        if done == size:
            return out[: max(0, len(codes) - size + 1)]
        h, have = _joined(h, h, have), have * 2


def _joined(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    n = max(0, min(len(left), len(right) - gap))
    h = (left[:n] * _STEP) ^ (right[gap : gap + n] + np.uint64(gap))
    return (h ^ (h >> np.uint64(29))) * _STEP


def common_bound(a: str, b: str, least: int) -> int:
    """How many characters of ``a`` lie in windows of ``least`` that also stand in ``b``; tiles can't cover more."""
    held = {b[k : k + least] for k in range(len(b) - least + 1)}
    covered = end = 0
    for k in range(len(a) - least + 1):
        if a[k : k + least] in held:
            covered += k + least - max(k, end)
            end = k + least
    return covered


def tiled(a: str, b: str, least: int) -> int:
    """Greedy string tiling: how many characters of ``a`` lie in tiles of ``least`` or more that ``a`` and ``b`` share.

    Long tiles go first, by search lengths that halve down to ``least``; a tile is as long as unmarked characters on both
    sides agree, and is marked on both, so that a passage of one text covers a passage of the other once only. In a round
    every place of either text is looked at once and every place of ``b`` is dropped from its list once, so a round is
    linear in the two lengths, and the number of rounds is the logarithm of the longest length.
    """
    size = min(len(a), len(b))
    if size < least:
        return 0
    ca, cb = _codes(a), _codes(b)
    free_a, free_b = bytearray(b"\x01") * len(a), bytearray(b"\x01") * len(b)
    lengths = [least]
    while lengths[-1] * 2 <= size:
        lengths.append(lengths[-1] * 2)
    covered = 0
    for length in reversed(lengths):
        ha, hb = _windows(ca, length), _windows(cb, length)
        shared = np.isin(ha, hb)
        if not shared.any():
            continue
        places: dict[int, list[int]] = {}
        for j in np.flatnonzero(np.isin(hb, ha))[::-1].tolist():
            places.setdefault(int(hb[j]), []).append(j)
        hashes, at = ha.tolist(), 0
        for k in np.flatnonzero(shared).tolist():
            if k < at or not free_a[k] or not free_a[k + length - 1]:
                continue
            found = places[hashes[k]]
            while found and not (free_b[found[-1]] and free_b[found[-1] + length - 1]):
                found.pop()
            # Every tile so far is as long as the window or longer, so a window with both ends free is free.
            if not found or a[k : k + length] != b[found[-1] : found[-1] + length]:
                continue
            j = found.pop()
            end, other = k + length, j + length
            while end < len(a) and other < len(b) and free_a[end] and free_b[other] and a[end] == b[other]:
                end, other = end + 1, other + 1
            free_a[k:end], free_b[j:other] = bytes(end - k), bytes(end - k)
            covered, at = covered + end - k, end
    return covered


def _said(text: str) -> str:
    return "".join(filter(str.isalnum, text))


def _said_once(answer: str) -> str:
    """The letters and digits of an answer, without lines that it repeats; a text said over and over counts once."""
    a = consistent_form(answer).lower()
    a = "".join(dict.fromkeys(map(_said, a.split("\n")))) if "\n" in a else _said(a)
    period = (a + a).find(a, 1) if a else 0
    return a[:period]


def gives_back(question: str, answer: str) -> bool:
    """Whether the answer is, for the most part, the question or the text in it."""
    a, q = _said_once(answer), _said(consistent_form(question).lower())
    if len(a) < 5 or not q:
        return False
    least = min(TILE_HAN if _count("han", a) * 2 > len(a) else TILE_OTHER, len(a))
    needed = max(COVER_ANSWER * len(a), COVER_QUESTION * len(q))
    if len(a) < needed or sum(map(set(q).__contains__, a)) < needed:
        return False  # too short, or too many characters that the question doesn't have
    # A text that stands in the other as it is makes one tile.
    return a in q or (common_bound(a, q, least) >= needed and tiled(a, q, least) >= needed)


def called_for(system: str, question: str) -> str:
    """The language that an answer is expected in: a translation's target, else that of the instruction."""
    for text in (question, system):
        if _ASKS_TRANSLATION.search(text):
            for name, pattern in _INTO.items():
                if pattern.search(text):
                    return name
    instruction = system if _HAS_LETTER.search(system) else question
    return _instructed(instruction)


@lru_cache(maxsize=1024)
def _instructed(instruction: str) -> str:
    """The language of an instruction; a table has few different ones."""
    return "zh" if _SCRIPT["han"].search(instruction) else written_in(instruction) or "en"


def _count(script: str, text: str) -> int:
    return sum(map(len, _SCRIPT[script].findall(text)))


def written_in(answer: str) -> str | None:
    """The language of the answer's values by script and function words; None where there is too little to tell."""
    # A text most of whose characters are Chinese needs no closer look, whatever its keys and links are.
    if not answer.isascii() and (many := _count("han", answer)) * 2 > len(answer) and many > 3 and not _SCRIPT["kana"].search(answer):
        return "zh"
    s = _KEY.sub(" ", answer)
    words = _ASCII_WORD.findall(s.lower()) if s.isascii() else [w.lower() for w in _LATIN_WORD.findall(s)]
    counts = dict.fromkeys(_SCRIPT, 0)
    if not s.isascii():
        counts["han"] = _count("han", s)
        if _OTHER_SCRIPTS.search(s):
            counts = {k: _count(k, s) for k in _SCRIPT}
    weights = counts | {"latin": 2 * len(words)}
    total = sum(weights.values())
    if total < 4:
        return None
    if counts["kana"] > 0.15 * total:
        return "ja"
    script = max(weights, key=lambda k: weights[k])
    if script != "latin":
        return {"han": "zh", "hangul": "ko", "cyrillic": "ru", "kana": "ja", "arabic": "ar", "thai": "th"}[script]
    hits = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for word in words:
        held = _HELD_BY.get(word) or (_HELD_BY.get(_ELIDED.sub("", word), ()) if "'" in word or "’" in word else ())
        for language in held:
            hits[language] += 1 / len(held)
    for language, sign in _OWN_SIGNS.items() if not s.isascii() else [("fr", _OWN_SIGNS["fr"])] if "'" in s else []:
        hits[language] += len(sign.findall(s))
    best = max(hits, key=lambda k: hits[k])
    if hits[best] < 0.5:
        return None if len(words) < 4 else "en"
    return "en" if best != "en" and hits[best] <= hits["en"] else best


def defects_beside_cuts(system: str, question: str, answer: str | None) -> tuple[str | None, str | None]:
    """The defect that goes before a cut, and the one that counts if the answer isn't cut."""
    if is_shell(answer):
        return "empty", None
    if refuses(answer):
        return "refusal", None
    if question and gives_back(question, answer):
        return "copy", None
    found = written_in(answer)
    return None, "language" if found and found != called_for(system, question) else None


def defect_of(system: str, question: str, answer: str | None, model: Model, least: float = UNKNOWN_ODDS) -> str | None:
    """The one defect of an answer, the first that applies in the order of ``DEFECTS``; None for a good answer."""
    before, after = defects_beside_cuts(system, question, answer)
    if before:
        return before
    return "truncated" if log_odds(answer, model) > least else after


def defective_pairs(df: DataFrame, turn: str = "turn_id", messages: str = "messages", response: str = "response", contexts: int = CONTEXTS) -> DataFrame:
    """``turn_id, defect`` of every turn whose answer is defective; good answers give no row.

    Null responses, contents and messages are allowed: a null or blank answer is ``empty``; without a question an answer
    can't be a ``copy``. The last user message is the question, the first system message the instruction. What the finish
    reason says isn't read. A repeated turn is judged again. One Arrow hop besides the n-gram counts; no shuffle of texts.
    """
    rows = df.select(
        at(df, turn).alias("turn_id"),
        F.coalesce(_content(at(df, messages), "system", 1), F.lit("")).alias("system"),
        F.coalesce(_content(at(df, messages), "user", -1), F.lit("")).alias("question"),
        at(df, response)["content"].alias("answer"),
    ).where(F.col("turn_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            systems, questions, answers = (batch.column(k).to_pylist() for k in (1, 2, 3))
            found = [defects_beside_cuts(s, q, a) for s, q, a in zip(systems, questions, answers, strict=True)]
            cuts = settle_all([None if f[0] else a for f, a in zip(found, answers, strict=True)], [False] * len(found))
            named = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *named, *cuts], ["turn_id", "before", "after", *SETTLED_NAMES])

    judged = settled(map_batches(rows, run, f"turn_id bigint, before string, after string, {SETTLED}"), rows.select(F.col("answer").alias("text")), contexts)
    defect = F.coalesce("before", F.when(F.col("cut"), "truncated"), "after")
    return judged.select("turn_id", defect.alias("defect")).where(F.col("defect").isNotNull())


def _content(messages, role: str, place: int):
    """The content of the first (1) or last (-1) message of a role; null where there is none."""
    found = F.filter(messages, lambda m: m["role"] == role)
    return F.try_element_at(found, F.lit(place))["content"]
