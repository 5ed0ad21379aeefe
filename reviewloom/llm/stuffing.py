"""Problem 10: pages of repeated search words, links or tags, by a prose-trained n-gram model of word classes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import map_batches, pick

# Function words as grammars list them, Chinese ones of one and of two characters (particles, pronouns,
# prepositions, conjunctions, adverbs of degree, time and scope, auxiliaries, classifiers, localizers), and those of languages
# with spaces.
ZH_ONE = "的了是在和也就都很还不没有我你他她它这那个与及或而但被把让给对从到向比跟又再才只更最太真挺着过吗呢吧啊呀哦嘛之其因所以如若则却能会可要想去来用得地后前里上下中时等"
ZH_TWO = (
    "就是 不过 另外 而且 并且 加上 可惜 尤其 再说 但是 可是 因为 所以 因此 由于 如果 假如 要是 虽然 尽管 即使 还是 或者 以及 而是 于是 然后 然而 从而 只是 只要 只有 除了 关于 对于 根据 "
    "真的 确实 的确 一直 依旧 仍然 依然 算是 倒是 整体 相当 特别 非常 比较 十分 有点 几乎 已经 曾经 正在 刚刚 马上 常常 往往 可以 可能 应该 必须 需要 能够 没有 不是 不会 不能 不要 什么 怎么 怎样 为何 哪里 哪个 "
    "这个 那个 这些 那些 这里 那里 这样 那样 这么 那么 我们 你们 他们 她们 它们 自己 大家 别人 有人 有些 一些 一点 一个 一下 之后 之前 以后 以前 以上 以下 之间 时候 的话 来说 起来 出来 下来 过来 上去 至少 毕竟 其实 甚至 属于 为了 通过 同时 此外 总之 例如"
)
WORDS = (
    "the a an and or but of to in on at by for with from as is are was were be been has have had do does did will would can could may might not no it its this that these those "
    "i you he she we they my your his her our their me him us them if when while though although because so than then there here which who what how very more most just also only "
    "after before over under about into out up down all any some each every one again still even too first own same such both through during until "
    "le la les un une des du de et ou mais est sont pas pour dans sur avec que qui ce cette il elle nous vous je au aux plus très été à "
    "el los las del y en es por con se lo como pero muy su "
    "и в не на что с по это как а то все но для от за из у к же бы был была нас мы вы она он очень ещё "
)

#: Word classes. Content counts by length; what repeats what stands shortly before it has classes of its own.
BEGIN, FUNCTION, SHORT, MIDDLE, LONG, AGAIN_SHORT, AGAIN_LONG, NUMBER, PAUSE, END, COLON, BREAK, SIGN, LINK, TAG, GAP, AGAIN_CHAIN = range(17)
CLASSES = 17
#: From so many repeated content words on end, further ones are a chain.
CHAIN = 5
#: Tokens whose mean decides about the one in their middle; and how far back, in characters, a repetition counts.
WINDOW, BACK = 21, 160
#: A line break is a wrap only after a line of so many characters.
WRAP = 40
#: A link counts as so many characters at most, so that a few cited links don't outweigh the text around them.
LINK_SIZE = 12
#: Characters whose repetition counts: so many Chinese ones, or so many of an alphabet.
GRAM_HAN, GRAM_OTHER = 4, 10
#: A window is abnormal so many standard deviations from the mean of the training windows.
DEVIATIONS = 3.0
#: An abnormal window is one of a list if at least this share of its content words are repeated ones, links or tags; or if it
#: has hardly any function words, or few and neither a sentence's end nor a sign of code, without being code or labelled values. Prose of another kind
#: than the corpus's, code and sheets have an odd perplexity as well, but aren't lists.
LISTED, FEW_FUNCTION, SOME_FUNCTION, CODE_SIGNS, LABELLED, ECHOED = 0.25, 0.1, 0.4, 0.1, 0.12, 0.4
#: For the most part: more than half of a page's characters.
MOST = 0.5


_LINK = regex.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"'，。！？；、)\]]+|(?<![\w@.])(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}/[^\s<>\"'，。！？；、)\]]+|</?[A-Za-z][^<>]*>")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    """A class for every character: 1 Chinese, 2 letter, 3 digit, 4 space, 5 break, else its sign class + 16."""
    table = np.full(0x110000, SIGN + 16, np.uint8)
    for start, stop in ((0x3400, 0x9FFF), (0x20000, 0x323AF), (0x3040, 0x30FF)):
        table[start : stop + 1] = 1
    for start, stop in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x370, 0x52F), (0x1E00, 0x1FFF), (0xAC00, 0xD7A3)):
        table[start : stop + 1] = 2
    table[[0xD7, 0xF7]] = SIGN + 16
    table[0x30:0x3A] = 3
    for chars, kind in ((" \t　\xa0", 4), ("\n\r", 5), ("，,、；;", PAUSE + 16), ("。！？!?.…", END + 16), ("：:", COLON + 16), ("#＃", TAG + 16), ("'’", 2)):
        for c in chars:
            table[ord(c)] = kind
    return table


_KIND = _kinds()
_CODE = np.zeros(0x110000, bool)
_CODE[[ord(c) for c in "(){}[]=_+\"'`\\$&@^%"]] = True
_ONE = np.zeros(0x110000, bool)
_ONE[[ord(c) for c in ZH_ONE]] = True
_TWO = np.unique([ord(w[0]) * 0x110000 + ord(w[1]) for w in ZH_TWO.split() if len(w) == 2])
_FIRST = np.zeros(0x110000, bool)
_FIRST[[ord(w[0]) for w in ZH_TWO.split()]] = True


def _word_hash(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each run of characters."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    where = np.arange(len(codes)) - np.repeat(starts, lengths)
    mixed = (codes.astype(np.uint64) + np.uint64(7)) * (where.astype(np.uint64) * _MIX + np.uint64(0xD6E8FEB86659FD93))
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), starts)


def _hash_words(words: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([_word_hash(np.array([ord(c) for c in w]), np.array([0]), np.array([len(w)])) for w in words]))


_FUNCTION_WORDS = _hash_words(sorted(set(WORDS.split())))


class Tokens(NamedTuple):
    """The word classes of some texts, one after the other; a text begins with BEGIN."""

    classes: np.ndarray
    lengths: np.ndarray  # characters of each token
    text: np.ndarray  # which text it is of
    echo: np.ndarray  # whether it is a content word that stands within the last BACK characters of its text as well
    code: np.ndarray  # whether it is a sign of program code: brackets, quotation marks, operators
    han: np.ndarray  # by text: whether it is mostly Chinese


def _repeated(codes: np.ndarray, text: np.ndarray, size: int, usable: np.ndarray) -> np.ndarray:
    """Which characters lie in a run of ``size`` usable ones that also stands within the last BACK characters of its text.

    The run is held against its nearest earlier one that it doesn't overlap, so words of a shorter period count as well.
    """
    n = len(codes)
    covered = np.zeros(n + 1, np.int64)
    if n <= size:
        return covered[:n] > 0
    h = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ codes[k : n - size + 1 + k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    within = (text[: n - size + 1] == text[size - 1 :]) & (np.r_[0, np.cumsum(~usable)][size:] == np.r_[0, np.cumsum(~usable)][: n - size + 1])
    places = np.flatnonzero(within)
    if not len(places):
        return covered[:n] > 0
    h = h[places] ^ (text[places].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(h, kind="stable")
    at = places[order]
    group = np.cumsum(np.r_[False, h[order][1:] != h[order][:-1]])
    # Groups one after the other, by place within: the last entry of the same group that lies ``size`` or more before.
    keys = group * (n + size) + size + at
    earlier = np.searchsorted(keys, keys - size, "right") - 1
    hits = at[(earlier >= 0) & (group[earlier] == group) & (at - at[earlier] <= BACK)]
    np.add.at(covered, hits, 1)
    np.add.at(covered, np.minimum(hits + size, n), -1)
    return np.cumsum(covered[:n]) > 0


def _labels_again(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, what: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which runs are labels, before a colon at the start of a line, that stood as one shortly before, too."""
    first = np.r_[True, (what[:-1] == 5) | (what[:-1] == 0)]
    return _echoes(codes, starts, lengths, np.isin(what, (1, 2)) & first & (np.r_[what[1:], 0] == COLON + 16), text)


def _wraps(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Line breaks that only wrap a paragraph: single ones between a letter or a pause and a small letter.

    A following indent doesn't matter. In a list of words that begin with small letters the line before is short.
    """
    breaks = np.flatnonzero(codes == 10)
    if not len(breaks):
        return breaks
    n = len(codes)
    solid = np.flatnonzero(kind != 4)
    after = solid[np.minimum(np.searchsorted(solid, breaks, "right"), len(solid) - 1)]
    before = breaks - 1
    line = breaks - np.r_[-1, breaks[:-1]]
    text_begins = np.flatnonzero(kind == 0)
    line = np.minimum(line, breaks - text_begins[np.searchsorted(text_begins, breaks) - 1])
    small = (kind[after] == 2) & (after > breaks)
    joined = np.isin(kind[before], (2, 3, 4, PAUSE + 16, END + 16, SIGN + 16))
    return breaks[small & joined & (line >= WRAP) & (breaks + 1 < n)]


def _echoes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which of the chosen runs stand, with the same characters, within the last BACK characters of their text."""
    echo, at = np.zeros(len(starts), bool), np.flatnonzero(chosen)
    if len(at) > 1:
        offsets = np.r_[0, np.cumsum(lengths[at])[:-1]]
        flat = np.repeat(starts[at] - offsets, lengths[at]) + np.arange(lengths[at].sum())
        h = _word_hash(codes[flat], offsets, lengths[at]) ^ (text[starts[at]].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(h, kind="stable")
        near = (h[order][1:] == h[order][:-1]) & (starts[at][order][1:] - starts[at][order][:-1] <= BACK)
        echo[at[order[1:][near]]] = True
    return echo


def tokenize(texts: list[str]) -> Tokens:
    """Word classes by table look-up over all characters at once; links and mark-up by one pattern."""
    parts = []
    for t in texts:
        marked = "/" in t or "<" in t or "www." in t
        parts.append(_LINK.sub(lambda m: "\x01" * min(len(m[0]), LINK_SIZE), t.lower()) if marked else t.lower())
    joined = "\x02" + "\x02".join(parts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    begun = codes == 2
    text = np.cumsum(begun) - 1
    kind = _KIND[codes].astype(np.int64)
    kind[codes == 1] = LINK + 16
    kind[begun] = 0
    kind[_wraps(codes, kind)] = 4
    han, letter = kind == 1, kind == 2
    function = han & _ONE[codes]
    two = np.flatnonzero(_FIRST[codes[:-1]])
    two = two[np.isin(codes[two] * 0x110000 + codes[two + 1], _TWO)]
    function[two] = True
    function[two + 1] = True
    again = _repeated(codes, text, GRAM_HAN, han) | _repeated(codes, text, GRAM_OTHER, letter | (kind == 4))
    # Runs: of content and of function characters, of letters (a word), of digits, of every other class.
    run_kind = kind.copy()
    run_kind[function] = 6
    starts = np.flatnonzero(np.r_[True, (run_kind[1:] != run_kind[:-1]) | begun[1:] | begun[:-1]])
    lengths = np.diff(np.r_[starts, len(codes)])
    what = run_kind[starts]
    share = np.add.reduceat(again.astype(np.int64), starts) * 2 >= lengths
    classes = np.where(what >= 16, what - 16, SIGN)
    classes[what == 0] = BEGIN
    classes[what == 6] = FUNCTION
    classes[what == 3] = NUMBER
    classes[what == 5] = BREAK
    content = what == 1
    classes[content] = np.where(lengths[content] <= 2, SHORT, np.where(lengths[content] <= 4, MIDDLE, LONG))
    words = np.flatnonzero(what == 2)
    flat = np.flatnonzero(np.repeat(what == 2, lengths))
    hashes = _word_hash(codes[flat], np.r_[0, np.cumsum(lengths[words])[:-1]] if len(words) else words, lengths[words])
    known = np.isin(hashes, _FUNCTION_WORDS)
    classes[words] = np.where(known, FUNCTION, np.where(lengths[words] <= 3, SHORT, np.where(lengths[words] <= 9, MIDDLE, LONG)))
    # Letters next to digits are codes.
    code = (what == 2) & ((np.r_[what[1:], 0] == 3) | (np.r_[0, what[:-1]] == 3))
    classes[code] = NUMBER
    share |= _labels_again(codes, starts, lengths, what, text)
    repeats = share & np.isin(classes, (SHORT, MIDDLE, LONG))
    classes[repeats] = np.where(classes[repeats] == SHORT, AGAIN_SHORT, AGAIN_LONG)
    # White space parts Chinese items like a sign; elsewhere it only parts words. It counts with the token before it.
    blank = what == 4
    between = blank & np.r_[False, np.isin(what[:-1], (1, 6, 3))] & np.r_[np.isin(what[1:], (1, 6)), False]
    classes[between] = GAP
    content = np.flatnonzero(np.isin(classes, (SHORT, MIDDLE, LONG, AGAIN_SHORT, AGAIN_LONG)))
    if len(content):
        fresh = ~np.isin(classes[content], (AGAIN_SHORT, AGAIN_LONG)) | np.r_[True, text[starts[content]][1:] != text[starts[content]][:-1]]
        place = np.arange(len(content))
        classes[content[place - np.maximum.accumulate(np.where(fresh, place, 0)) > CHAIN]] = AGAIN_CHAIN
    echo = _echoes(codes, starts, lengths, np.isin(classes, (SHORT, MIDDLE, LONG, AGAIN_SHORT, AGAIN_LONG, AGAIN_CHAIN)), text)
    code = (classes == SIGN) & _CODE[codes[starts]]
    keep = ~blank | between
    owner = np.maximum(np.cumsum(keep) - 1, 0)
    sizes = np.bincount(owner, weights=lengths, minlength=int(keep.sum())).astype(np.int64)
    of = text[starts][keep]
    number = len(texts)
    mostly = np.bincount(text, weights=han, minlength=number) * 2 >= np.bincount(text, weights=letter, minlength=number)
    return Tokens(classes[keep], sizes - (classes[keep] == BEGIN), of, echo[keep], code[keep], mostly)


def _windows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token's window begins and ends, within its text."""
    n, half = len(text), WINDOW // 2
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    ends = np.r_[first[1:], n]
    begin, end = np.repeat(first, ends - first), np.repeat(ends, ends - first)
    at = np.arange(n)
    # At a text's edge the window keeps its width, if the text is as long.
    low = np.maximum(begin, np.minimum(at - half, end - WINDOW))
    return low, np.minimum(end, np.maximum(at + half + 1, begin + WINDOW))


def _window_sums(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Around each token, within its text: the sum over the window and the window's number of tokens."""
    low, high = _windows(text)
    total = np.r_[0, np.cumsum(values)]
    return total[high] - total[low], high - low


def _contexts(t: Tokens) -> np.ndarray:
    one = np.r_[0, t.classes[:-1]]
    two = np.r_[0, 0, t.classes[:-2]][: len(t.classes)]
    one[t.classes == BEGIN] = 0
    two[(t.classes == BEGIN) | (one == BEGIN)] = 0
    return (two * CLASSES + one) * CLASSES + t.classes


def _prose(t: Tokens) -> np.ndarray:
    """Tokens to train on: windows with function words and few repetitions, or of labelled lines; without links and tags."""
    share, (low, high) = {}, _windows(t.text)
    for name, kinds in (("function", (FUNCTION,)), ("again", (AGAIN_SHORT, AGAIN_LONG, AGAIN_CHAIN)), ("chain", (AGAIN_CHAIN,)), ("web", (LINK, TAG)), ("colon", (COLON,)), ("break", (BREAK,)), ("sign", (SIGN, GAP))):
        total = np.r_[0, np.cumsum(np.isin(t.classes, kinds))]
        share[name] = (total[high] - total[low]) / (high - low)
    prose = (share["function"] >= 0.2) & (share["again"] <= 0.3)
    sheet = (share["colon"] >= 0.14) & (share["break"] >= 0.1) & (share["again"] <= 0.12)
    return (prose | sheet) & (share["web"] == 0) & (share["chain"] == 0) & (share["sign"] <= 0.2)


def count_classes(texts: list[str]) -> np.ndarray:
    """``[language, class trigram]`` over the tokens of prose windows; language 1 is Chinese."""
    counts = np.zeros((2, CLASSES**3), np.int64)
    if texts:
        t = tokenize(texts)
        chosen, language = _prose(t), t.han[t.text].astype(np.int64)
        counts += np.bincount((language * CLASSES**3 + _contexts(t))[chosen], minlength=2 * CLASSES**3).reshape(2, -1)
    return counts


class Model(NamedTuple):
    logs: np.ndarray  # [language, class trigram]: log P(class | two before)
    low: np.ndarray  # by language: a window's mean below it has an abnormally high perplexity
    high: np.ndarray  # above it an abnormally low one


def fit(counts: np.ndarray) -> Model:
    """Trigrams smoothed by bigrams and these by single classes; limits from the mean and spread of the training tokens."""
    logs, low, high = np.zeros(counts.shape), np.zeros(2), np.zeros(2)
    for k in range(2):
        c = counts[k].reshape(CLASSES, CLASSES, CLASSES).astype(float)
        single = (c.sum((0, 1)) + 1) / (c.sum() + CLASSES)
        two = (c.sum(0) + 8 * single) / (c.sum((0, 2))[:, None] + 8)
        three = (c + 8 * two[None]) / (c.sum(2)[..., None] + 8)
        logs[k] = np.log(three).reshape(-1)
        n = max(1.0, c.sum())
        mean = (counts[k] * logs[k]).sum() / n
        spread = np.sqrt(max(1e-9, (counts[k] * (logs[k] - mean) ** 2).sum() / n) / WINDOW)
        low[k], high[k] = mean - DEVIATIONS * spread, mean + DEVIATIONS * spread
    return Model(logs, low, high)


def _listed(t: Tokens) -> np.ndarray:
    """Around each token: whether its window is one of a list of words, links or tags."""
    low, high = _windows(t.text)
    width = high - low

    def count(chosen: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(chosen)]
        return total[high] - total[low]

    again, fresh = np.isin(t.classes, (AGAIN_SHORT, AGAIN_LONG, AGAIN_CHAIN, LINK, TAG)), np.isin(t.classes, (SHORT, MIDDLE, LONG))
    content = count(again | fresh)
    listed = count(again) >= LISTED * content
    function, code = count(t.classes == FUNCTION), count(t.code)
    bare = (function <= FEW_FUNCTION * content) | ((function <= SOME_FUNCTION * content) & (count(t.classes == END) + code == 0))
    few_labels = (count(t.classes == COLON) <= LABELLED * width) | (count(t.echo) >= ECHOED * content)
    return (content > 0) & (listed | (bare & (code <= CODE_SIGNS * width) & few_labels))


def abnormal_shares(texts: list[str], model: Model) -> np.ndarray:
    """For each text: the share of its characters in windows of abnormal perplexity."""
    if not texts:
        return np.zeros(0)
    t = tokenize(texts)
    language = t.han[t.text].astype(np.int64)
    logs = model.logs.reshape(-1)[language * CLASSES**3 + _contexts(t)]
    total, width = _window_sums(logs, t.text)
    mean = total / width
    odd = (mean < model.low[language]) | (mean > model.high[language])
    n = len(texts)
    # Most texts have no odd window; only the others are looked at for lists.
    some = (np.bincount(t.text[odd], minlength=n) > 0)[t.text]
    if some.any():
        odd[some] &= _listed(Tokens(*[x[some] for x in t[:-1]], t.han))
    return np.bincount(t.text, weights=t.lengths * odd, minlength=n) / np.maximum(1, np.bincount(t.text, weights=t.lengths, minlength=n))


def train(df: DataFrame, text: str) -> Model:
    """Counts over every text; a task sends 2 x 17**3 numbers at most, and so many reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, CLASSES**3), np.int64)
        for batch in batches:
            for part in _slices(batch.column(0).to_pylist()):
                counts += count_classes(part)
        flat = counts.reshape(-1)
        slots = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(flat[slots], pa.int64())], ["slot", "n"])

    texts = pick(df, text=text).where(F.col("text").isNotNull())
    rows = map_batches(texts, run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * CLASSES**3, np.int64)
    counts[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return fit(counts.reshape(2, -1))


def _slices(texts: list[str], characters: int = 400_000) -> Iterator[list[str]]:
    """Parts of a batch of about so many characters, whole texts each, so that long texts take no more memory."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part


def stuffed_shares(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record_id, share``: of every text, the share of characters in stretches that are no prose.

    Null and empty texts have share 0; repeated rows come out as often as they are. Two Arrow hops, one to train and one to
    score; nothing but class counts is shuffled. Thresholds come from the counts over all texts.
    """
    rows = pick(df, record_id=record, text=text)
    shared = df.sparkSession.sparkContext.broadcast(train(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            shares = [abnormal_shares(part, model) for part in _slices([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([*shares, np.zeros(0)]), pa.float64())], ["record_id", "share"])

    return map_batches(rows, run, "record_id bigint, share double")


def stuffed_pages(df: DataFrame, record: str, text: str, most: float = MOST) -> DataFrame:
    """``record_id`` of the pages that are repeated words, links or tags for the most part."""
    return stuffed_shares(df, record, text).where((F.col("share") > most) & F.col("record_id").isNotNull()).select("record_id")
