"""Defective prompt and answer pairs by a label model over noisy labelling functions.

For each defect some labelling functions vote +1 (defective), -1 (sound) or 0 (abstain) on every pair.  The
votes of a defect form one of at most ``3 ** functions`` patterns; the counts of the patterns over *all* pairs
are a table of bounded size.  On it expectation-maximization fits a two-class model in which the functions are
independent given the class, each with its own table P(vote | class).  The posterior of each pattern is joined
back; a pair keeps every defect whose posterior exceeds that defect's cutoff.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.confusables import consistent as skeleton_nfc
from weftline.session import staged

#: Defects and their labelling functions, in the order of the votes.
FUNCTIONS = {
    "empty": ("no_letter", "no_digit", "few_characters"),
    "truncated": ("final_mark", "open_code", "open_item", "dangling_word", "literal_answer", "symbol_at_end", "finish_reason", "copy_of_prompt"),
    "refusal": ("self_negation", "declining_word", "talk_of_answering", "speaker", "opening", "closing", "topic", "substance", "length"),
    "copied_question": ("coverage", "uncovered_run", "uncovered_share", "new_sentence", "prompt_coverage"),
    "other_language": ("script", "function_words", "shared_words", "sentence_majority", "trigrams"),
}
#: Where the votes of a function begin: how often it calls a sound pair defective and a defective pair sound.  Others: 0.025.
START = {
    "no_letter": (0.025, 1e-6), "no_digit": (0.5, 1e-6), "few_characters": (0.1, 0.1),
    "self_negation": (0.05, 0.3), "speaker": (0.1, 0.2), "declining_word": (0.03, 0.4), "talk_of_answering": (0.1, 0.2), "opening": (0.05, 0.4), "closing": (0.03, 0.5), "topic": (0.4, 0.2), "substance": (0.4, 0.2), "length": (0.4, 0.2),
    "shared_words": (0.2, 0.1), "trigrams": (0.2, 0.1),
}
#: Functions whose tables stay as they begin: an answer with a letter or a digit is not empty by definition.
FIXED = ("no_letter", "no_digit")
#: Cutoffs on the posterior, chosen by ``best_cutoff`` on one set of planted defects of ``tests/llm`` and tested on another.
CUTOFFS = {"empty": 0.49, "truncated": 0.48, "refusal": 0.55, "copied_question": 0.5, "other_language": 0.6}

#: Likeness of the short words of prompt and answer below and above which they speak for two languages and for one.
LOW_LIKENESS, HIGH_LIKENESS = 0.08, 0.3

_THINK = re.compile(r"(?is)<think\s*>.*?</think\s*>")
_CODE = re.compile(r"(?s)```.*?(?:```|\Z)")
_QUOTE = re.compile(r"[\"“„«]([^\"“”„«»]*)[\"”»]|(?m:^\s*>.*$)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_LITERAL = re.compile(r"\W*(?:[A-Za-z]|[\d.,]+%?|(?i:yes|no|true|false|oui|non|ja|nein|sí|да|нет|是|否))\W*")
_HAN = re.compile(r"[㐀-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_NOT_LATIN = re.compile(r"[Ѐ-ӿ㐀-鿿]")
_ASCII_LETTER = re.compile(r"[A-Za-z]")
_BEYOND = re.compile(r"[^\W\d_A-Za-z]")
_MIXED_WORD = re.compile(r"\b(?=\w*[A-Za-z])\w*[Ͱ-֏]\w*")
_MIXED = re.compile(r"[A-Za-z][Ͱ-֏]|[Ͱ-֏][A-Za-z]")
_WORD = re.compile(r"[㐀-鿿]|[^\W_]+")

#: Frequent function words of the languages in the data.
FUNCTION_WORDS = {
    "en": "the a an and of in on at to for with without by is are was does do if not no neither nor what which why how where when every most some about because but more before after should can could near beside under behind inside against you this that have has it we your my would".split(),
    "de": "der die das den dem des ein eine einen einem und oder nicht mit ohne für von bei auf im zu zum zur über unter nach vor seit wie wann warum weshalb wohl sind ist werden wird ich mir dass ob weil".split(),
    "fr": "le la les l un une des du de et ou pas avec sans pour par chez dans sur sous depuis quand comment pourquoi est que qui je vous ce cette ne plus au aux".split(),
    "es": "el la los las un una unos unas y o no con sin para por en de del al que qué cuándo cómo es son se lo ya pese tras desde sobre si".split(),
    "ru": "и или не в на с без для по под за от до из о об как когда почему что это ли где же к у".split(),
}
#: Frequent words of further languages that no list above has.
MORE_WORDS = {
    "pt": "não uma os da em na é são com mais pelo pela você mas ao dos foi também isso nos pelos uns".split(),
    "it": "il lo gli di che è non per della nel sono più anche una alla dei delle questo questa perché quando ogni".split(),
    "nl": "het een van niet met voor zijn wordt naar ook maar dat bij deze geen veel werd heeft omdat".split(),
    "pl": "nie się jest że jak dla ale tak są przez oraz który która tylko przed bez przy".split(),
    "sv": "och att det är som på av för till inte han kan från eller ett har vid mycket".split(),
    "tr": "bir ve bu için ile çok olan olarak daha gibi kadar sonra değil her ne".split(),
}
#: Letters beyond ASCII of languages in Latin letters.
_BEYOND_ASCII = {"en": "", "de": "äöüß", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü"}
_LANGS_OF: dict[str, list[str]] = {}
for _l, _ws in FUNCTION_WORDS.items():
    for _w in _ws:
        _LANGS_OF.setdefault(_w, []).append(_l)
_LANGS_OF["a"] = ["en", "other"]  # a word of many languages
for _l, _ws in MORE_WORDS.items():
    for _w in _ws:
        if not set(_LANGS_OF.get(_w, ())) & set(FUNCTION_WORDS):
            _LANGS_OF.setdefault(_w, []).append(_l)

class _Wording:
    """A pattern for texts in Latin letters, tried where a word begins with one of ``heads``, and one for other letters."""

    def __init__(self, heads: str, latin: str, other: str):
        self.heads, self.latin, self.other = frozenset(heads.split()), re.compile(latin), re.compile(other)

    def search(self, text: str, heads: set[str], beyond: bool) -> bool:
        return not self.heads.isdisjoint(heads) and bool(self.latin.search(text)) or beyond and bool(self.other.search(text))


#: The speaker negates what it does, can, may or wants, or says that it declines.
_SELF_NEGATION = _Wording(
    "i we ich wir mir gebe je j m nous no not prefi préfè debo tengo me",
    r"\b(?:i|we)(?:'\w+)?(?:\s+\w+){0,2}?\s+(?:can't|cannot|won't|shan't|wouldn't|couldn't|don't|mustn't|not|never|unable|rather not)\b(?!\s+(?:stress|emphasi[sz]e|overstate|recommend|wait|believe|imagine|thank|help but|agree more))"
    r"|\bnot\b[^.!?]{0,30}\b(?:i|we)(?:'\w+| am| are)? (?:willing|able|allowed|permitted|prepared)\b|\b(?:not|no)\b[^.!?]{0,25}\b(?:for|from|by) (?:me|us|my side|our side)\b|\b(?:ich|wir|mir)\b(?:\s+\w+){0,5}?\s+(?:nicht|keine?\w*|unmöglich)\b"
    r"|\bgebe\s+(?:ich|wir)\b(?:\s+\w+){0,4}?\s+keine|\bje\s+(?:ne\b|n'|préfère ne)|\bj'(?:aime(?:rais)? mieux ne|évite)|\bm'est\s+(?:impossible|interdit)"
    r"|\bnous\s+ne\b|\bno\s+(?:me\s+|nos\s+|te\s+|le\s+)?(?:puedo|podemos|debo|quiero|voy|vamos|deseo|corresponde|permiten?|es posible|tengo|estoy|sé)\b"
    r"|\b(?:prefiero|preferimos)\s+no\b|\b(?:i|we) (?:must|have to|need to) (?:decline|refuse|pass)\b|\b(?:i|we) (?:refuse|decline)\b|\b(?:muss|müssen) (?:ich|wir) (?:\w+ )?(?:ablehnen|verweigern)"
    r"|\bje (?:dois|vais|préfère) (?:refuser|décliner)\b|\bje refuse\b|\b(?:debo|tengo que) (?:rechazar|declinar)|\bme niego\b",
    r"\b(?:я|мы)(?:\s+[\w-]+){0,3}?\s+не\b|\bмне\s+(?:нельзя|не\b|запрещ)|\bне\s+(?:могу|буду|стану|хочу|имею|вправе|можем|будем|готов)|\b(?:я|мы) (?:вынужден|должн|обязан)\w*\s+(?:отклон|отказ)"
    r"|(?:我|我们|本人).{0,6}(?:不|无法|没法|拒)|(?:无法|不能|不便|不可以|不方便|不会).{0,6}(?:回答|帮|提供|讨论|处理|说|谈)",
)
#: Words of declining, in whatever sentence.
_DECLINING = _Wording(
    "again outsi beyon decli refus rejec withh refra absta rathe prefe pass no stay keep steer not ableh verwe keine décli absti m préfè recha niego abste prefi",
    r"\b(?:declin|refus|reject|withhold|refrain|abstain)\w*|\b(?:against|outside|beyond) (?:my|our|what (?:i|we))\b|\b(?:rather|prefer) not\b|\bpass on\b|\bno (?:reply|comment|answer|response)\b"
    r"|\b(?:stay|keep|steer) (?:away|clear|out)\b|\bnot (?:something|a (?:topic|subject|question)) (?:i|we)\b|\bablehn|\bverweiger"
    r"|\bkeine (?:auskunft|antwort|stellung)|\bdécliner|\bm'abst|\bpréfère ne|m'est (?:impossible|interdit)|\brechaz|\bniego|\babsteng|\bprefiero no",
    r"отклон|отказ|воздерж|нельзя|не стану|拒绝|谢绝|婉拒|不(?:方)?便|不愿|不能多说",
)
#: Talk of helping, answering, permission and rules rather than of the matter.
_TALK = _Wording(
    "help assis answe discu comme cover reque guide polic allow permi right comfo somet someo someb some one take into talk asked told instr helfe weite antwo beant anfra ausku richt erlau befug äußer aider répon abord parle autor mesur deman ayuda respo conte habla comen corre petic pregu",
    r"\b(?:help|assist)\b[^.!?]{0,12}\b(?:with|you)\b|\b(?:answer(?:ing)?|discuss(?:ing)?|comment on|cover) (?:\w+ ){0,2}?(?:this|that|it|such|your|the (?:matter|topic))\b|\bpermission\b|\btalk about\b"
    r"|\banswering would\b|\bmay not cover\b|\b(?:this|that|your|such(?: a)?) requests?\b|\bdiscuss\b|\bcomment on\b|\bguidelines?\b|\bpolic(?:y|ies)\b"
    r"|\ballowed\b|\bpermitted\b|\bright for me\b|\bcomfortable\b|\bsome(?:one|body) else\b|\bthis one\b|\btake on\b|\bgo into\b|\b(?:weiter)?helfen\b"
    r"|\b(?:asked|told|instructed) (?:not )?to\b|\b(?:be)?antworten\b|\banfrage\b|\bauskunft\b|\brichtlinien\b|\berlaubt\b|\bbefugt\b|\bäußern\b|\b(?:vous )?aider\b|\brépondre\b|\baborder\b|\bparler\b"
    r"|\bautoris|\ben mesure\b|\bdemande\b|\bayudar|\bresponder\b|\bcontestar\b|\bhablar\b|\bcomentar\b|\bpermiso\b|\bcorresponde\b|\bpetición\b|\bpregunta\b",
    r"помочь|помогать|отвечать|ответить|обсуждать|говорить|просьб|запрос|права|правил|帮|回答|请求|问题|讨论|处理|谈论|规定|多说",
)
_OPENING = _Wording(
    "sorry apolo unfor afrai regre hones thank leid leide entsc danke désol malhe merci hélas sient desgr lamen graci",
    r"\bsorry\b|\bapolog\w*|\bunfortunately\b|\bafraid\b|\bregret\w*|\bto be honest\b|\bthanks for asking\b|\bes tut mir leid|\bleider\b|\bentschuldig"
    r"|\bdanke für|\bdésolé|\bmalheureusement|\bmerci pour|\bhélas\b|\blo siento|\bpor desgracia|\blamentablemente|\bgracias por preguntar",
    r"к сожалению|простите|извините|спасибо за вопрос|увы|抱歉|很遗憾|对不起|不好意思",
)
_CLOSING = _Wording(
    "under anyth anoth rephr somet quest compr ander etwas verst frage entie pregu",
    r"\bi hope you understand|\banything else\b|\banother (?:topic|question)|\brephrase\b|\bsomething else\b|\bautre question|\bcompréhension|\betwas anderes"
    r"|\bverständnis|\bandere frage|\blo entiendas|\botra pregunta|\bcomprensión",
    r"о чём-нибудь другом|понимание|другой вопрос|换一个问题|(?:希望|谢谢|感谢|您的).{0,6}理解|请谅解|其他问题",
)
#: The speaker, named.
_SPEAKER = set("i we me us my our ich wir mir mich uns je j nous moi m yo nosotros mí me mi я мы мне нам меня мой нашей 我 咱".split())
#: Words after which no sentence ends.
_DANGLING = set(
    "the a an and or of in on at to for with without by because which that is are if but than as der die das und oder mit ohne für von weil dass le la les un une des et ou avec pour parce que qui los las el y o con para por porque и или с для потому что который".split()
)
_ASKS = re.compile(
    r"(?i)\btranslate\b.{0,40}\binto (\w+)|\b(?:answer|reply|respond|write|explain)\b.{0,30}\bin (english|german|french|spanish|russian|chinese)\b"
    r"|\b(?:übersetze?n?|antworte|schreibe?)\b.{0,60}\b(?:ins|auf) (\w+)|\b(?:tradui\w*|répon\w+|écri\w+)\b.{0,60}\ben (\w+)|\b(?:traduc\w*|respond\w*|contesta\w*|escrib\w*)\b.{0,60}\b(?:al|en) (\w+)"
    r"|(?:переведи\w*|ответь\w*|напиши\w*).{0,60}\b(?:на|по)[ -](\w+)|(?:翻译成|译成|用)([英德法俄中汉西]\w{0,3})[语文]?"
)
_NAMES = {
    "en": ("english", "englisch", "anglais", "inglés", "ingles", "англ", "英"),
    "de": ("german", "deutsch", "allemand", "alemán", "aleman", "немец", "德"),
    "fr": ("french", "französisch", "français", "francais", "francés", "frances", "франц", "法"),
    "es": ("spanish", "spanisch", "espagnol", "español", "espanol", "испан", "西"),
    "ru": ("russian", "russisch", "russe", "ruso", "русск", "俄"),
    "zh": ("chinese", "chinesisch", "chinois", "chino", "китай", "中", "汉"),
}


def answer_of(content: str | None) -> str:
    """The answer: content without complete think spans."""
    return _THINK.sub("", content or "").strip()


def _readable(text: str) -> str:
    """Full-width and look-alike characters brought to one form where a word mixes scripts."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    return skeleton_nfc(text) if _MIXED.search(text) else text


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@cache
def _script_of(ch: str) -> str:
    """The script of a letter beyond ASCII, from its name."""
    name = unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() else ""
    return {"CJK": "han", "HIRAGANA": "kana", "KATAKANA": "kana", "FULLWIDTH": "latin"}.get(name, name.lower())


def _script(text: str) -> str | None:
    """The script of most letters; a Han character or a syllable counts as two letters."""
    if text.isascii():
        return "latin" if _ASCII_LETTER.search(text) else None
    counts = Counter({"latin": len(_ASCII_LETTER.findall(text))})
    if _BEYOND.search(text):
        for ch, n in Counter(_BEYOND.findall(text)).items():
            if kind := _script_of(ch):
                counts[kind] += n * (1 + (kind in ("han", "kana", "hangul")))
        for word in _MIXED_WORD.findall(text):  # look-alikes among letters that have none
            if kinds := [k for k in map(_script_of, _BEYOND.findall(word)) if k and k != "latin"]:
                latin = len(_ASCII_LETTER.findall(word))
                counts["latin"] -= latin
                counts[kinds[0]] += latin
        if counts["kana"] > 0.1 * counts["han"]:  # both write one language
            counts["kana"] += counts.pop("han", 0)
    best, total = max(counts, key=counts.get), sum(counts.values())
    return best if total and counts[best] >= 0.6 * total else None


def _alien(text: str, lang: str | None) -> float:
    """Share of letters that the alphabet of a language in Latin letters does not have."""
    if text.isascii() or lang not in _BEYOND_ASCII:
        return 0.0
    letters = _BEYOND.findall(text.lower())
    return sum(ch not in _BEYOND_ASCII[lang] for ch in letters) / (len(letters) + len(_ASCII_LETTER.findall(text)))


def _trigrams(words: list[str]) -> Counter:
    """Three characters in a row of the words of at most six letters: mostly function words and endings."""
    t = f" {' '.join([w for w in words if len(w) <= 6 and w.isalpha()])} "
    return Counter(zip(t, t[1:], t[2:]))


def _cosine(a: Counter, b: Counter) -> float:
    both = sum(n * b[t] for t, n in a.items() if t in b)
    return both / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if both else 0.0


def _language_scores(text: str, words: list[str]) -> Counter:
    scores: Counter = Counter()
    for langs in map(_LANGS_OF.get, words):
        if langs is not None:
            for lang in langs:
                scores[lang] += 1 / len(langs)
    if _NOT_LATIN.search(text):
        scores["zh"] += len(_HAN.findall(text)) / 2
        if _script(text) == "cyrillic":
            scores["ru"] += 2
    return scores


def _leader(scores: Counter, margin: float = 1.5, least: float = 1.0) -> str | None:
    """The language of the greatest score, if it is ahead of the next by ``margin``."""
    best, top, second = None, 0.0, 0.0
    for lang, x in scores.items():
        if x > top:
            best, top, second = lang, x, top
        elif x > second:
            second = x
    return best if top >= least and top >= margin * second else None


def _prose(answer: str) -> list[str]:
    """Sentences without code, quotations and a short courtesy opening."""
    text = _QUOTE.sub(" ", _CODE.sub(" ", answer))
    sentences = [s for s in _SENTENCE.split(text) if s and any(c.isalpha() for c in s)]
    if len(sentences) > 1 and (len(sentences[0].split()) <= 4 and len(sentences[0]) <= 24):
        sentences = sentences[1:]
    return sentences


def _asked_language(prompt: str) -> str | None:
    low = prompt.lower()
    if prompt.isascii() and not any(x in low for x in ("transl", "answer", "reply", "respond", "writ", "expl", "schreib", "tradu", "cont", "escrib")):
        return None
    for m in _ASKS.finditer(prompt):
        name = next((g for g in m.groups() if g), "").lower()
        for lang, names in _NAMES.items():
            if name.startswith(names):
                return lang
    return None


def _covered(words: list[str], by: list[str], k: int) -> list[bool]:
    """Which words lie in a run of ``k`` words (of all words, if fewer) that ``by`` has too."""
    k = min(k, len(words), len(by))
    held = set(zip(*(by[i:] for i in range(k))))
    out = [False] * len(words)
    for i, g in enumerate(zip(*(words[i:] for i in range(k)))):
        if g in held:
            out[i : i + k] = [True] * k
    return out


def votes(prompt: str | None, content: str | None, finish: str | None) -> dict[str, tuple[int, ...]]:
    """The votes of all labelling functions on one pair."""
    answer, asked = answer_of(content), _readable(prompt or "").strip()
    has = any(map(str.isalnum, answer))
    few = 1 if len(answer) <= 3 else 0 if len(answer) <= 12 else -1
    out = {"empty": (-1 if any(map(str.isalpha, answer)) else 1, -1 if any(map(str.isdigit, answer)) else 1, few)}
    if not has:
        return out | {d: (-1,) * len(f) for d, f in FUNCTIONS.items() if d != "empty"}
    parts = [(x, _words(x)) for x in _SENTENCE.split(answer)]
    words, p_words = [w for _, ws in parts for w in ws], _words(asked)
    p_set, heads = set(p_words), {w[:5] for w in words}
    literal = bool(_LITERAL.fullmatch(answer))
    plain = answer.lower().replace("’", "'")
    copies = False

    han = bool(_HAN.search(answer))
    if p_words and not literal:
        covered = _covered(words, p_words, 7 if han else 4)
        share = sum(covered) / len(words)
        run = max((sum(1 for _ in g) for hit, g in itertools.groupby(covered) if not hit), default=0)
        room = 10 if han else 5
        new = at = 0
        for _, ws in parts:
            k = len(ws)
            new += k >= 4 and sum(covered[at : at + k]) < 0.3 * k
            at += k
        copies = share >= 0.7 and run <= room
        back = sum(_covered(p_words, words, 7 if han else 4)) / len(p_words)
        out["copied_question"] = (
            1 if copies else -1 if share <= 0.4 or run >= 2 * room else 0,
            1 if run <= room else -1 if run >= room + 2 else 0,
            1 if share >= 0.8 and run <= room else -1 if share < 0.5 or run >= 2 * room else 0,
            -1 if new else 0,
            1 if back >= 0.5 and run <= room else -1 if back < 0.2 else 0,
        )
    else:
        out["copied_question"] = (-1,) * 5

    code_open = answer.count("```") % 2 == 1
    end, last_line = answer.rstrip("*_ \u200b\ufe0f")[-1:], answer.rsplit("\n", 1)[-1].strip()
    open_item = bool(re.fullmatch(r"\d+[.)]|[-*•]", last_line)) and "\n" in answer
    symbol = bool(end) and not end.isalnum() and ord(end) >= 0x2190 and end not in "。！？）】」』"
    marked = end in ".!?。！？…)）\"”»'’`]}"
    tail = re.sub(r"\W+$", "", last_line).lower().split()
    dangling = bool(tail) and tail[-1] in _DANGLING and not marked and not literal and not copies
    out["truncated"] = (
        0 if literal or copies or code_open or open_item or symbol else -1 if marked else 1,
        1 if code_open else -1 if end == "`" else 0,
        1 if open_item else 0,
        1 if dangling else 0,
        -1 if literal else 0,
        -1 if symbol else 0,
        1 if finish == "length" else 0,
        -1 if copies else 0,
    )

    bare = _QUOTE.sub(" ", _CODE.sub(" ", plain))
    long_words = [w for w in words if len(w) >= 5 or han and _HAN.match(w)]
    held = sum(map(p_set.__contains__, long_words))
    topical = held / max(1, len(long_words))
    on_topic = sum(sum(len(w) >= 4 for w in p_set.intersection(ws)) >= 2 for _, ws in parts)
    beyond = bool(_NOT_LATIN.search(bare))
    negated, declined, talk, opening, closing = (x.search(bare, heads, beyond) for x in (_SELF_NEGATION, _DECLINING, _TALK, _OPENING, _CLOSING))
    out["refusal"] = (
        1 if negated else -1,
        1 if declined else -1,
        1 if talk else -1,
        1 if not _SPEAKER.isdisjoint(words) else -1,
        1 if opening else -1,
        1 if closing else -1,
        -1 if literal or topical >= 0.25 and held >= 3 else 1 if topical < 0.1 and asked else 0,
        -1 if literal or on_topic >= 2 or code_open else 1 if not on_topic else 0,
        -1 if literal or len(words) > 60 or "```" in answer else 1 if len(words) <= 20 else 0,
    )

    sentences = _prose(_readable(answer))
    prose, wanted = " ".join(sentences), _asked_language(asked)
    p_text = _QUOTE.sub(" ", _CODE.sub(" ", asked))
    p_text = p_text if any(c.isalpha() for c in p_text) else asked
    if literal or not prose or not p_words:
        out["other_language"] = (-1,) * 5
        return out
    by_sentence, total, said = Counter(), Counter(), []
    p_own = p_words if p_text == asked else _words(p_text)
    for x in sentences:
        said += (own_words := _words(x))
        scores = _language_scores(x, own_words)
        for k, score in scores.items():
            total[k] += score
        if (best := _leader(scores, 1.01)) is not None:
            by_sentence[best] += len(x)
    lang, p_lang, script, p_script = _leader(total, least=3.0), wanted or _leader(_language_scores(p_text, p_own)), _script(prose), _script(p_text)
    major = max(by_sentence, key=by_sentence.get) if by_sentence and len(sentences) > 1 else None
    if wanted:
        p_script = {"ru": "cyrillic", "zh": "han"}.get(wanted, "latin")
    differ = lambda a, b: 0 if a is None or b is None else 1 if a != b else -1
    p_han = bool(_HAN.search(asked))
    own = {w for w in p_set if len(w) >= 3 and w in _LANGS_OF or p_han and _HAN.match(w)}
    shared = sum(map(own.__contains__, words)) / max(1, len(words))
    alike = _cosine(_trigrams(said), _trigrams(p_own)) if len(words) >= 10 and len(p_words) >= 6 and not wanted and script == p_script else None
    out["other_language"] = (
        1 if differ(script, p_script) == 1 or _alien(prose, p_lang) >= 0.03 else 0 if script == "latin" else differ(script, p_script),
        differ(lang, p_lang),
        0 if wanted else 1 if shared < 0.02 and len(words) >= 6 and len(own) >= 3 else -1 if shared >= 0.1 else 0,
        differ(major, p_lang),
        0 if alike is None else 1 if alike < LOW_LIKENESS else -1 if alike >= HIGH_LIKENESS else 0,
    )
    return out


def _code(vote: tuple[int, ...]) -> int:
    code = 0
    for v in vote:
        code = 3 * code + v + 1
    return code


def _decode(code: int, k: int) -> tuple[int, ...]:
    out = []
    for _ in range(k):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return tuple(reversed(out))


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("completion_id", pa.int64()), ("choice_index", pa.int32()), *((d, pa.int32()) for d in FUNCTIONS)])
    for b in batches:
        cid, idx, prompt, content, finish = (b.column(i).to_pylist() for i in range(5))
        coded = [[_code(v[d]) for d in FUNCTIONS] for v in map(votes, prompt, content, finish)]
        cols = [list(c) for c in zip(*coded)] if coded else [[] for _ in FUNCTIONS]
        yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(idx, pa.int32()), *(pa.array(c, pa.int32()) for c in cols)], schema=schema)


def fit_label_model(counts: dict[int, int], functions: int | Sequence[str], prior: float = 0.06, strength: float = 0.01, rounds: int = 50) -> dict[int, float]:
    """Posterior of each vote pattern by expectation-maximization.

    ``functions`` are their names (or number).  The tables P(vote | class) start from ``START`` and stay tied to that start by
    pseudo-counts of ``strength`` times the number of pairs and 50 more, which keeps a class from drifting to another
    meaning, however few the pairs are.
    """
    names = range(functions) if isinstance(functions, int) else functions
    codes = sorted(counts)
    if not codes:
        return {}
    n = np.array([counts[c] for c in codes], float)
    v = np.array([_decode(c, len(names)) for c in codes]) + 1
    start = np.array([[[1 - alarm, alarm], [miss, 1 - miss]] for alarm, miss in (START.get(f, (0.025, 0.025)) for f in names)])
    table, fixed = start.copy(), [f in FIXED for f in names]
    cast = np.stack([v == 0, v == 2], axis=2).astype(float)  # neither where a function abstains, which tells nothing
    pseudo = (strength * n.sum() + 50) * np.array([[1 - prior], [prior]])
    pi, post = prior, np.full(len(codes), prior)
    for _ in range(rounds):
        like = np.log(np.array([1 - pi, pi]))[None] + np.einsum("cfv,fyv->cy", cast, np.log(table))
        like -= like.max(axis=1, keepdims=True)
        post = np.exp(like[:, 1]) / np.exp(like).sum(axis=1)
        weight = np.stack([n * (1 - post), n * post])
        pi = float(np.clip((weight[1].sum() + prior * pseudo.sum()) / (n.sum() + pseudo.sum()), 1e-4, 0.5))
        votes = np.einsum("yc,cfv->fyv", weight, cast)
        table = (votes + pseudo * start) / (votes.sum(axis=2, keepdims=True) + pseudo)
        table[fixed] = start[fixed]
    return dict(zip(codes, post.tolist()))


def best_cutoff(scored: Sequence[tuple[float, bool]]) -> float:
    """The cutoff of greatest F1 over ``(posterior, defective)``, half-way between two posteriors; of equals the middle one."""
    ranked, total = sorted(scored, reverse=True), sum(y for _, y in scored)
    hits, best, at = 0, -1.0, []
    for i, (p, y) in enumerate(ranked):
        hits += y
        after = ranked[i + 1][0] if i + 1 < len(ranked) else 0.0
        if p > after:
            f1 = 2 * hits / (i + 1 + total)
            at = [(p + after) / 2] if f1 > best + 1e-12 else at + [(p + after) / 2] if f1 > best - 1e-12 else at
            best = max(best, f1)
    return at[len(at) // 2] if at else 0.5


def answer_pairs(messages: DataFrame, completions: DataFrame, requests: DataFrame) -> DataFrame:
    """``(completion_id, choice_index, prompt, content, finish_reason)`` of each choice with a known request.

    The prompt is the content of the last user turn; requests without one give a null prompt.  Repeated rows
    count once.
    """
    prompts = messages.where("role = 'user' and request_id is not null").groupBy("request_id").agg(F.max_by("content", "turn").alias("prompt"))
    known = requests.where("request_id is not null").select("request_id").distinct()
    once = completions.where("completion_id is not null and request_id is not null").groupBy("completion_id").agg(F.first(F.struct("request_id", "choices")).alias("c"))
    choices = once.select("completion_id", F.col("c.request_id").alias("request_id"), F.explode("c.choices").alias("choice"))
    flat = choices.select("completion_id", "request_id", F.col("choice.index").alias("choice_index"), F.col("choice.message.content").alias("content"), F.col("choice.finish_reason").alias("finish_reason"))
    return flat.join(known, "request_id", "left_semi").join(prompts, "request_id", "left").select("completion_id", "choice_index", "prompt", "content", "finish_reason")


def posteriors(pairs: DataFrame) -> DataFrame:
    """``(completion_id, choice_index, defect, posterior)`` for every pair and defect."""
    spark = pairs.sparkSession
    src = pairs.select(F.col("completion_id").cast("bigint"), F.col("choice_index").cast("int"), "prompt", "content", "finish_reason")
    coded = staged(src.mapInArrow(_vote_batches, "completion_id bigint, choice_index int, " + ", ".join(f"{d} int" for d in FUNCTIONS)), "pair-votes")
    long = coded.select("completion_id", "choice_index", F.explode(F.create_map(*itertools.chain.from_iterable((F.lit(d), F.col(d)) for d in FUNCTIONS))).alias("defect", "pattern"))
    # at most the sum of 3 ** functions rows, whatever the number of pairs
    counted = long.groupBy("defect", "pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = []
    for defect, functions in FUNCTIONS.items():
        counts = {r["pattern"]: r["n"] for r in counted if r["defect"] == defect}
        rows += [(defect, c, p) for c, p in fit_label_model(counts, functions).items()]
    table = spark.createDataFrame(rows, "defect string, pattern int, posterior double")
    return long.join(F.broadcast(table), ["defect", "pattern"]).select("completion_id", "choice_index", "defect", "posterior")


def broken_pairs(pairs: DataFrame, cutoffs: dict[str, float] | None = None) -> DataFrame:
    """Each defective pair with each of its defects.

    Null prompts leave the prompt-bound functions abstaining; a null answer is empty; equal rows give equal
    rows once; an empty table gives an empty result.
    """
    limit = F.create_map(*itertools.chain.from_iterable((F.lit(d), F.lit(c)) for d, c in (CUTOFFS | (cutoffs or {})).items()))
    return posteriors(pairs).where(F.col("posterior") > limit[F.col("defect")]).select("completion_id", "choice_index", "defect").distinct()
