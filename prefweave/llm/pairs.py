"""Broken prompt and response pairs.

Each side of a record gets at most one defect, looked for in this order: ``empty``,
``copies_prompt`` (coverage by the prompt's suffix automaton), ``refusal`` (an automaton over
phrases, and nothing else answered), ``truncated`` (a stack of delimiters, and how the last
sentence or list entry ends), ``other_language`` (votes of function words and scripts).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefweave.llm.leak import Automaton

# Phrases by which an answer declines, and sentences that may accompany them.
REFUSALS = """
can't help with|cannot help with|can not help with|can't help you|cannot help you|can't provide|cannot provide|can't assist|cannot assist|can't answer|cannot answer|can't comply|cannot comply|can't discuss|cannot discuss|can't do that|cannot do that|can't comment|cannot comment|can't share|cannot share
i'm unable to|i am unable to|i'm not able to|i am not able to|not possible for me|must decline|have to decline|i decline|must refuse|have to refuse|i refuse|have to pass on|won't be answering|will not be answering|won't answer|will not answer|won't help|will not help|would rather not|i'd rather not|prefer not to|i do not discuss|i don't discuss|falls outside what i|outside what i may|not comfortable|against my guidelines|not something i can|not something i'm|not something i am|isn't something i|beyond what i'm|beyond what i am|beyond what i can|outside of my abilities|outside my abilities|beyond my abilities|outside of my scope|outside my scope|beyond my capabilities|outside my capabilities|would be inappropriate|off limits for me|off-limits for me|against my policy|against our policy|against my principles|prefer to stay neutral|prefer to remain neutral|rather stay neutral|rather remain neutral
kann ich nicht helfen|kann ich leider nicht|kann dir nicht helfen|kann ihnen nicht helfen|kann dabei nicht|nicht weiterhelfen|muss ich leider ablehnen|muss ich ablehnen|muss leider ablehnen|lehne ich ab|darf ich mich nicht|darf ich nicht|nicht beantworten|möchte ich nicht|möchte mich nicht|ist mir nicht möglich|ich nicht in der lage|übersteigt meine möglichkeiten|außerhalb meiner möglichkeiten|übersteigt meine
no puedo ayudar|no puedo responder|no puedo contestar|no puedo proporcionar|no puedo comentar|no puedo hacer eso|no me es posible|no es posible para mí|tengo que rechazar|debo rechazar|debo negarme|prefiero no|no estoy en condiciones|me niego a|fuera de mis posibilidades|más allá de mis capacidades|fuera de lo que puedo
je ne peux pas|je ne puis|je dois refuser|je dois décliner|je refuse|je préfère ne pas|il ne m'est pas possible|il m'est impossible|je ne suis pas en mesure|je ne suis pas autorisé|dépasse ce que je peux|au-delà de ce que je peux|hors de mes compétences|hors de mes capacités|il ne m'appartient pas|m'est impossible|m'est interdit
не могу с этим помочь|не могу помочь|не могу ответить|не могу вам помочь|я вынужден отказаться|я вынуждена отказаться|должен отказаться|нельзя отвечать|мне нельзя|не буду отвечать|отказываюсь|предпочту не|не имею возможности|не в состоянии|выходит за рамки моих|за пределами моих возможностей|не входит в мои обязанности
"""
# By language, who declines, how, and what is declined, in this order within a sentence. No
# subject: the verb has it. A "+" marks a way of declining that needs no act. With a word of regret,
# listed last, no act is needed either.
DECLINING = {
    "en": (
        "i|i'm|i'll|i'd|we|we're",
        "can't|cannot|can not|could not|couldn't|won't|will not|not able to|unable to|not willing to|unwilling to|not permitted to|not allowed to|not going to|not in a position to|not authorised to|not authorized to|not at liberty to|not prepared to|don't think i should|do not think i should|should not|shouldn't|must refrain from|have to refrain from|choose not to|choosing not to|won't be|will not be|not inclined to|not free to|not qualified to|prefer not to|rather not|+must decline|+have to decline|+need to decline|+decline to|+declining to|+decline this|+decline that|+respectfully decline|+refuse to|+must refuse|+say no to|+must say no|+have to say no|+turn this down|+turn that down|+turn down|+have to pass on|+not comfortable|refrain from|+do not take positions|+don't take positions|+do not give opinions|+don't give opinions",
        "help|assist|answer|answering|respond|responding|reply|comment|commenting|discuss|discussing|weigh in|opinion|opinions|a view|comply|fulfil|fulfill|complete|do that|do this|do so|go into|talk about|speak about|speak to|write that|write this|provide|providing|share|offer|offering|engage|advise|support|fulfilling|continue with|proceed|accommodate|address that|address this|carry out|grant|evaluate|evaluating|judge|judging|process|give|giving|feedback|recommend|review|analyse|analyze|get into|touch on|say more|take part|take sides|perform|oblige|continue",
        "sorry|apologies|apologise|apologize|unfortunately|regret|regrettably|regretfully|afraid|forgive me|pardon",
    ),
    "de": (
        "ich|mir",
        "nicht|nichts|keine|keinen|kein|+lehne|+ablehnen|+zurückweisen|+verweigern|+absagen|+nicht gestattet|+nicht erlaubt|+untersagt",
        "helfen|weiterhelfen|behilflich|beantworten|antworten|äußern|äussern|erfüllen|nachkommen|sprechen|besprechen|auskunft|stellung|stellungnahme|meinung|eingehen|kommentieren|unterstützen|tun|dienen|beraten|diskutieren|bearbeiten|ausführen|antwort|sagen|abgeben|bewerten|beurteilen|schreiben|mitteilen|weiterführen",
        "leid|leider|entschuldigung|entschuldige|entschuldigen|bedaure|bedauere|bedauerlicherweise|verzeihung|verzeih",
    ),
    "fr": (
        "je|j'|il m'|m'",
        "ne peux|ne puis|ne pourrai|ne souhaite|ne veux|ne vais|ne suis pas|ne serai pas|ne donnerai|ne répondrai|ne ferai|+décliner|+rester neutre|n'ai pas le droit|préfère ne|+je refuse|+dois refuser|+dois décliner|+m'abstenir|+m'est interdit|+m'est impossible|+décline",
        "aider|aide|répondre|réponse|parler|discuter|commenter|faire cela|faire ça|le faire|accéder|satisfaire|avis|fournir|aborder|donner suite|traiter|prononcer|exprimer|opinion|mesure|autorisé|autorisée|habilité|écrire|juger|évaluer|donner|dire",
        "désolé|désolée|excuse|excuser|excusez|malheureusement|regrette|navré|navrée|pardon",
    ),
    "es": (
        "",
        "no puedo|no podré|no tengo permitido|no tengo permiso|preferiría no|no podría|no voy a|no estoy|no me está permitido|no me es posible|no se me permite|no quiero|no debo|no deseo|prefiero no|temo que no|+debo declinar|+debo rechazar|+tengo que declinar|+tengo que rechazar|+me niego|+me veo obligado a|+me veo obligada a|+debo negarme|+declino|+prefiero abstenerme",
        "ayudar|ayudarte|ayudarle|ayudarlo|responder|responderte|contestar|hablar|opinar|comentar|hacerlo|hacer eso|hacer esto|atender|proporcionar|cumplir|discutir|ofrecer|dar mi opinión|pronunciarme|tratar|autorizado|autorizada|compartir|realizar|escribir|opinión|evaluar|juzgar|dar|darte|darle|seguir|participar",
        "siento|lamento|lamentablemente|desafortunadamente|perdón|perdona|perdone|disculpa|disculpe|disculpas|desgraciadamente",
    ),
    "ru": (
        "",
        "не могу|не смогу|не стану|не буду|не хочу|не вправе|не имею права|не готов|не готова|мне не разрешено|мне не позволено|мне нельзя|не в состоянии|предпочитаю не|предпочту не|+отказываюсь|+вынужден отказать|+вынуждена отказать|+вынужден отклонить|+вынуждена отклонить|+должен отказать|+воздержусь|+предпочту воздержаться",
        "помочь|помогать|ответить|отвечать|обсуждать|комментировать|говорить|делать|выполнить|выполнять|сделать|обсудить|высказываться|высказать|дать ответ|поддержать|предоставить|рассуждать|писать|прокомментировать|советовать|посоветовать|оценивать|оценить|дать|давать|судить|рассказывать|рассказать|продолжать|участвовать",
        "извини|извините|прости|простите|сожалению|сожалею|прощения|увы",
    ),
}
COURTESIES = """
something else i can do|anything else i can|help you with something else|feel free|please consult|qualified person|professional instead|i appreciate|your patience|your understanding|hope that is all right|hope you understand|hope this is ok|take care|thank you|thanks for|have a nice|let me know|ask me about another|another subject|another topic|another question|something different|i'm sorry|i am sorry|sorry about|i apologize|my apologies|with regret|good luck|best wishes
bitte frag|etwas anderes|tut mir leid|danke|verständnis|alles gute|anderes thema|andere frage
otro tema|otra cosa|otra pregunta|por favor|lo siento|gracias|disculpa|perdona
autre chose|autre sujet|autre question|désolé|merci|bonne chance|s'il vous plaît
о чём-нибудь другом|о чем-нибудь другом|другую тему|другой вопрос|извините|простите|спасибо|пожалуйста
"""
# Frequent function words by language.
STOPWORDS = {
    "en": "the a an of to and in is are was were be been it its that this these those for with on at by from as or not but have has had you your i my we they their he she his her which what who how when if then than there so can could will would should do does did about into only more most some such no nor out up just also because while after before between through during without within each other both any all one",
    "de": "der die das den dem des ein eine einen einem einer und oder aber ist sind war waren wird werden wurde nicht auch mit von zu zum zur im in an am auf für als wie bei nach aus über unter vor durch ohne um dass weil wenn ob so noch nur schon sehr mehr man ich du er sie es wir ihr sich mein dein sein kein keine diese dieser dieses dort hier heute immer dann trotzdem obwohl zwischen gar nichts etwas wer was warum solange seit laut leute",
    "fr": "le la les un une des du de et ou mais est sont était étaient sera ne pas plus que qui quoi dont où ce cet cette ces il elle ils elles on nous vous je tu se sa son ses leur leurs au aux en dans sur sous avec sans pour par chez comme si quand bien très aussi encore déjà toujours tout tous toute rien cela ça y après avant entre depuis alors donc car jusque moi me mon mes été avoir être fait dit",
    "es": "el la los las un una unos unas de del y o pero es son era eran fue será no ni que quien quién cual cuál donde cuando como cómo si al en con sin por para sobre entre tras desde hasta hay ya muy más menos también todavía siempre nunca se su sus lo le les me te nos mi tu él ella ellos esto esta este eso esa ese algo nada todo todos aunque mientras porque pues así ahora antes después aquí allí está están ser estar había ha han cada otro otra",
    "ru": "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее её мне было вот от меня еще ещё нет о из ему теперь когда даже ну если уже или ни быть был него до вас опять для мы тебя их чем была сам чтоб без будто чего раз тоже себя под будет там потом кто этот того потому этого какой ним здесь этом один почти мой тем чтобы нее были куда зачем всех можно при об это эта эти между который которая которые очень где весь всё тут пока после через кроме сначала",
}
# How prompts name a language they want.
LANGUAGE_NAMES = {
    "en": "english englisch inglés ingles anglais английск английски",
    "de": "german deutsch alemán aleman allemand немецк немецки",
    "fr": "french französisch francés frances français francais французск французски",
    "es": "spanish spanisch español espanol castellano espagnol испанск испански",
    "ru": "russian russisch ruso russe русск русски",
}
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*[\"'”’»)\]*]*|[.!?…。！？]+")
_ENTRY = re.compile(r"[ \t]*(?:[-*+•]|\d{1,3}[.)])(?:[ \t]+|$)(.*)")
_END = ".!?…。！？؟।"
_CLOSERS = "\"'”’»“)]}*_~`」』"
#: what each bracket closes; intervals such as [0, 1) mix two kinds
_PAIRS = {")": "([", "]": "[(", "}": "{"}
#: code, and faces such as :( and :-[
_CODE = re.compile(r"```.*?```|`[^`\n]+`|(?<!\w)[:;=]['’]?-?[(\[{](?!\w)", re.S)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the defects."""

    copied_answer: float = 0.6  #: least share of the answer's words in runs of the prompt
    copied_prompt: float = 0.7  #: least share of the prompt's words that come back
    extra_words: int = 6  #: most words of the answer outside such runs
    run: int = 3  #: words of a copied run, fewer in prompts of fewer words
    short_answer: int = 3  #: words of a complete answer without an end mark
    foreign_share: float = 0.5  #: more than this share of the answer's judged words
    least_votes: float = 2.0
    refusal_words: int | None = None  #: if given, a sentence of more words answers something, whatever it declines


@lru_cache(1)
def _phrases() -> tuple[object, object]:
    import ahocorasick

    made = []
    for block in (REFUSALS, COURTESIES):
        a = ahocorasick.Automaton()
        for p in block.replace("\n", "|").split("|"):
            if p:
                a.add_word(p, p)
        a.make_automaton()
        made.append(a)
    acts = ahocorasick.Automaton()
    for lang, lists in DECLINING.items():
        for step, listed in enumerate(lists):
            for p in listed.split("|"):
                if p:
                    word = p.lstrip("+")
                    acts.add_word(word, (*acts.get(word, ()), (lang, step, p[0] == "+", len(word))))
    acts.make_automaton()
    return (*made, acts)


#: so many characters lie between two steps of declining at most
_APART = 60


def _declines(sentence: str) -> bool:
    """Does a sentence, in lower case, decline: by a known phrase, or by its subject, a negated verb, and an act, in this order?"""
    refuse, _, acts = _phrases()
    if next(refuse.iter(sentence), None) is not None:
        return True
    # of each language, the steps taken so far, and where the last one ended
    taken = {lang: (0 if lists[0] else 1, 0) for lang, lists in DECLINING.items()}
    regret: set[str] = set()
    for end, found in acts.iter(sentence):
        after = sentence[end + 1 : end + 2]
        for lang, step, enough, size in found:
            at = end + 1 - size
            if (at and sentence[at - 1].isalnum()) or (after.isalnum() and sentence[end] != "'"):
                continue  # a part of a word
            if step == 3:
                regret.add(lang)
                continue
            steps, last = taken[lang]
            # the next step, if near enough, or the last one once more
            if step == steps and (not last or at - last <= _APART) or step == steps - 1 and last:
                if step == 2 or enough:
                    return True
                taken[lang] = (step + 1, end + 1)
    return any(taken[lang][0] == 2 for lang in regret)


@lru_cache(1)
def _votes() -> dict[str, tuple[tuple[str, float], ...]]:
    by: dict[str, list[str]] = {}
    for lang, listed in STOPWORDS.items():
        for w in set(listed.split()):
            by.setdefault(w, []).append(lang)
    return {w: tuple((x, 1 / len(langs)) for x in langs) for w, langs in by.items()}


def is_refusal(text: str, rules: Rules = Rules()) -> bool:
    """Does the answer decline, and is every other sentence mere courtesy?"""
    polite = _phrases()[1]
    low = text.lower().replace("’", "'").replace("`", "'")
    declined = False
    for s in re.split(r"(?<=[.!?…])[\"'”’»)*]*\s+|\n+", low):
        if len(_WORD.findall(s)) <= 2:
            continue
        if _declines(s):
            declined = True
        elif next(polite.iter(s), None) is None:
            return False
    if not declined:
        return False
    # of a long sentence, what follows the refusal may be an answer
    return rules.refusal_words is None or all(len(_WORD.findall(s)) <= rules.refusal_words for s in re.split(r"[.!?…\n]+", low))


class Prompt:
    """A prompt's words and their suffix automaton, built when first needed."""

    def __init__(self, text: str) -> None:
        self.words = _WORD.findall(text.lower())
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        self.automaton: Automaton | None = None
        self.language = None
        self.text = text

    def copied(self, answer: list[str], rules: Rules) -> bool:
        """Is the answer little more than the prompt again?"""
        n, m = len(answer), len(self.words)
        if not n or m < 3:
            return m > 0 and answer == self.words
        ids = [self.ids.get(w, -1) for w in answer]
        # words that the prompt doesn't have can't be covered
        if n - ids.count(-1) < rules.copied_answer * n:
            return False
        if self.automaton is None:
            self.automaton = Automaton([[self.ids[w] for w in self.words]])
            self.where: dict[int, int] = {}
            state = 0
            for i, w in enumerate(self.words):
                state = self.automaton.next[state][self.ids[w]]
                at = state
                while at > 0 and at not in self.where:
                    self.where[at] = i
                    at = self.automaton.link[at]
        a, run = self.automaton, min(rules.run, m)
        covered, back = bytearray(n), bytearray(m)
        state = length = 0
        for i, c in enumerate(ids):
            while state and c not in a.next[state]:
                state = a.link[state]
                length = a.length[state]
            if c in a.next[state]:
                state, length = a.next[state][c], length + 1
            if length >= run:
                covered[i - length + 1 : i + 1] = b"\1" * length
                end = self.where[state]
                back[end - length + 1 : end + 1] = b"\1" * length
        inside = sum(covered)
        return inside >= rules.copied_answer * n and n - inside <= max(rules.extra_words, n // 10) and sum(back) >= rules.copied_prompt * m


def _bare(text: str) -> str:
    """Without white space, invisible characters, closing marks and emoji at the end."""
    i = len(text)
    while i:
        c = text[i - 1]
        if c.isalnum() or c in _END:
            break
        if not (c.isspace() or c in _CLOSERS or unicodedata.category(c) in ("Cf", "Mn", "Me", "Cc", "So", "Sk", "Co")):
            break
        i -= 1
    return text[:i]


def is_truncated(text: str, rules: Rules = Rules()) -> bool:
    """Does the answer break off inside a word, sentence, list entry, bracket or code block?"""
    fences = text.count("```")
    if fences % 2:
        return True
    if _open(_CODE.sub(" ", text)):
        return True
    tail = text.rstrip()
    if fences and tail.endswith("```"):
        return False
    bare = _bare(text)
    if not bare:
        return False
    lines = [x for x in bare.splitlines() if x.strip()]
    entry = _ENTRY.fullmatch(lines[-1])
    if entry is not None and (len(lines) > 1 or not entry.group(1)):
        body = entry.group(1).strip()
        if not body:
            return True
        before = [m.group(1).strip() for m in map(_ENTRY.fullmatch, lines[:-1]) if m]
        if body[-1] in _END:
            return False
        if body[-1] in ",:;—–-([{":
            return True
        if any(x and x[-1] in _END for x in before):
            return True
        sizes = {len(x.split()) for x in before}
        # entries of one length, and the last is shorter
        return len(before) > 1 and len(sizes) == 1 and len(body.split()) < min(sizes)
    if bare[-1] in _END:
        return False
    emoji = tail and unicodedata.category(_strip_invisible(tail)[-1:] or " ") == "So"
    if emoji:
        return bare[-1] in ",:;—–-([{"
    words = len(_WORD.findall(bare))
    return words > rules.short_answer or bare[-1] in ",:;—–-([{"


def _strip_invisible(text: str) -> str:
    i = len(text)
    while i and (text[i - 1].isspace() or unicodedata.category(text[i - 1]) in ("Cf", "Mn", "Cc")):
        i -= 1
    return text[:i]


def _open(text: str) -> bool:
    """Is a bracket opened anywhere and never closed? A closing one alone, as in "a)", doesn't count."""
    stack: list[str] = []
    for c in text:
        if c in "([{":
            stack.append(c)
        elif c in _PAIRS and stack and stack[-1] in _PAIRS[c]:
            stack.pop()
    return bool(stack)


def _script(word: str) -> str | None:
    """A language that the script alone names."""
    c = ord(word[0])
    if 0x3040 <= c <= 0x30FF:
        return "ja"
    if 0x4E00 <= c <= 0x9FFF:
        return "zh"
    if 0xAC00 <= c <= 0xD7AF:
        return "ko"
    if 0x0400 <= c <= 0x04FF:
        return "ru"
    if 0x0600 <= c <= 0x06FF:
        return "ar"
    if 0x0370 <= c <= 0x03FF:
        return "el"
    return None


def language(words: list[str]) -> tuple[str | None, float]:
    """The language with most votes of function words, and its lead over the next."""
    votes: dict[str, float] = {}
    known = _votes()
    for w in words:
        if v := known.get(w):
            for lang, n in v:
                votes[lang] = votes.get(lang, 0) + n
        elif not w.isascii() and (s := _script(w)):
            votes[s] = votes.get(s, 0) + 0.5
    if not votes:
        return None, 0.0
    top = max(votes, key=votes.__getitem__)
    return top, votes[top] - max((v for k, v in votes.items() if k != top), default=0.0)


def is_foreign(prompt: Prompt, answer: str, words: list[str], rules: Rules) -> bool:
    """Is most of the answer in another language than the prompt, which didn't ask for it?"""
    if prompt.language is None:
        prompt.language = language(prompt.words)
    own, lead = prompt.language
    if own is None or lead < 1:
        return False
    whole, by = language(words)
    if whole == own and by >= rules.least_votes and by > 0.12 * len(words):
        return False
    if len(words) < 4:
        return False
    judged: dict[str, int] = {}
    for s in _SENTENCE.findall(answer):
        w = _WORD.findall(s.lower())
        lang, margin = language(w)
        if lang and margin >= 1:
            judged[lang] = judged.get(lang, 0) + len(w)
    total = sum(judged.values())
    foreign = total - judged.get(own, 0)
    if not total or foreign <= rules.foreign_share * total or foreign < 4:
        return False
    most = max((k for k in judged if k != own), key=judged.__getitem__)
    low = prompt.text.lower()
    return not any(name in low for name in LANGUAGE_NAMES.get(most, "").split())


def defect(chat: list[dict] | None, other: list[dict] | None, rules: Rules = Rules(), prompts: dict[str, Prompt] | None = None) -> str | None:
    """The defect of a chat's last message as a reply to the last user message before it."""
    last = chat[-1] if chat else None
    answer = last["content"] if last and last["role"] == "assistant" else None
    words = _WORD.findall(answer.lower()) if answer else []
    if not words:
        return "empty"
    ask = _prompt(chat)
    if ask is None:
        ask = _prompt(other)
    if ask:
        prompt = (prompts or {}).get(ask)
        if prompt is None:
            prompt = Prompt(ask)
            if prompts is not None:
                prompts[ask] = prompt
        if prompt.copied(words, rules):
            return "copies_prompt"
    if is_refusal(answer, rules):
        return "refusal"
    if is_truncated(answer, rules):
        return "truncated"
    if ask and is_foreign(prompt, answer, words, rules):
        return "other_language"
    return None


def _prompt(chat: list[dict] | None) -> str | None:
    """The last user message before the last message, '' if it is empty; None without one."""
    return next((m["content"] or "" for m in reversed((chat or [])[:-1]) if m and m["role"] == "user"), None)


def broken_pairs(df: DataFrame, key: str, sides: tuple[str, str] = ("chosen", "rejected"), rules: Rules = Rules(), version: str | None = None) -> DataFrame:
    """(key, side, defect): every defective side of every record.

    A null chat, message, role or content is ``empty``, like a chat that ends in another role;
    a side without a user message takes the other side's prompt; without any prompt, or with an
    empty one, only ``empty``, ``refusal`` and ``truncated`` are told. A key that comes again counts as in its
    latest ``version`` (a null version is the earliest); of deliveries of one version, or without that column, the
    alphabetically first defect holds.
    A null key is left out; an empty table gives none. Other columns aren't read.
    """
    a, b = sides
    kind = df.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts: dict[str, Prompt] = {}
            at, side, found = [], [], []
            for i, (x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                for name, one, two in ((a, x, y), (b, y, x)):
                    if d := defect(one, two, rules, prompts):
                        at.append(i)
                        side.append(name)
                        found.append(d)
            if at:
                i = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(i), batch.column("version").take(i), pa.array(side), pa.array(found)], ["key", "version", "side", "defect"])

    at = F.col(version) if version else F.lit(0)
    vkind = df.schema[version].dataType.simpleString() if version else "int"
    known = df.where(F.col(key).isNotNull())
    own = known.select(F.col(key).alias("key"), at.alias("version"), F.col(a).alias("a"), F.col(b).alias("b"))
    out = own.mapInArrow(judge, f"key {kind}, version {vkind}, side string, defect string")
    if version:
        latest = known.groupBy(F.col(key).alias("key")).agg(F.max(version).alias("latest"))
        out = out.join(latest, "key").where(F.col("version").eqNullSafe(F.col("latest")))
    return out.groupBy("key", "side").agg(F.min("defect").alias("defect")).withColumnRenamed("key", key)
