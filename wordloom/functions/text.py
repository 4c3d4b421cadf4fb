"""Text as Column expressions: tokens, stop words, stems, n-grams and small string scalars.

Everything stays in the JVM. Patterns that have a SQL twin avoid look-around
and back-references, so that other engines read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"
#: Nearer to word segmentation: ideographs one by one, inner apostrophes, dots and colons between letters, dots and commas between digits.
RICH = r"[\p{IsHan}]|[\p{IsHiragana}]+|[\p{IsKatakana}]+|[\p{L}\p{N}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+(?:(?<=\p{L})['’.:](?=\p{L})[\p{L}\p{N}_]+|(?<=\p{N})[.,](?=\p{N})[\p{L}\p{N}_]+)*"
URL = r"(?i)\b(?:(?:https?|ftp|file)://|www\.)[^\s<>\"]+"

STOP_WORDS = sorted(
    set(
        """a about above after again against all am an and any are as at be because been before being below between both but by
        can could did do does doing down during each few for from further had has have having he her here hers herself him himself
        his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
        ourselves out over own same she should so some such than that the their theirs them themselves then there these they this
        those through to too under until up very was we were what when where which while who whom why will with would you your
        yours yourself yourselves""".split()
    )
)

VOWEL = "([aeiou]|.y)"
DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"


def tokens(text: Column, rich: bool = False) -> Column:
    """The text's tokens in order, in lower case; null for a null text."""
    if not rich:
        return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, URL, " ")), F.lit(RICH), F.lit(0))


def _runs(ordered: Column, differs, row) -> Column:
    """row(first place from 0, length) of every run of an ordered array; differs(place) says whether a run ends before it."""
    ends = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: F.coalesce(differs(i), F.lit(True)))
    start = lambda e, k: F.coalesce(F.get(e, k - 1), F.lit(0))
    return _let(ends, lambda e: F.transform(e, lambda end, k: row(start(e, k), end - start(e, k))))


def counted(tokens: Column) -> Column:
    """Each different token as a struct of term and tf, in order, counted within the row."""
    row = lambda s: lambda at, n: F.struct(F.get(s, at).alias("term"), n.cast("long").alias("tf"))
    return F.when(F.size(tokens) > 0, _let(F.sort_array(tokens), lambda s: _runs(s, lambda i: F.get(s, i) != F.get(s, i - 1), row(s))))


def placed(tokens: Column) -> Column:
    """Each different token as a struct of term, tf and its sorted positions, in order, gathered within the row."""
    row = lambda s: lambda at, n: F.struct(F.get(s, at)["term"].alias("term"), n.cast("long").alias("tf"), F.transform(F.slice(s, at + 1, n), lambda x: x["pos"]).alias("positions"))
    pairs = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.cast("long").alias("pos"))))
    return F.when(F.size(tokens) > 0, _let(pairs, lambda s: _runs(s, lambda i: F.get(s, i)["term"] != F.get(s, i - 1)["term"], row(s))))


def token_type(term: Column) -> Column:
    """NUMERIC, IDEOGRAPHIC, HIRAGANA, KATAKANA, HANGUL, SOUTHEAST_ASIAN or WORD."""
    return (
        F.when(term.rlike(r"^[\p{N}.,]+$"), "NUMERIC")
        .when(term.rlike(r"^\p{IsHan}+$"), "IDEOGRAPHIC")
        .when(term.rlike(r"^\p{IsHiragana}+$"), "HIRAGANA")
        .when(term.rlike(r"^\p{IsKatakana}+$"), "KATAKANA")
        .when(term.rlike(r"^\p{IsHangul}+$"), "HANGUL")
        .when(term.rlike(r"^[\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}]+$"), "SOUTHEAST_ASIAN")
        .otherwise("WORD")
    )


def lowercase(text: Column) -> Column:
    """In lower case; null for the empty text."""
    return F.lower(F.nullif(text, F.lit("")))


def is_stop_word(term: Column) -> Column:
    return term.isin(STOP_WORDS)


def without_stop_words(terms: Column) -> Column:
    return F.array_except(terms, F.array(*map(F.lit, STOP_WORDS)))


def _let(value: Column, use) -> Column:
    """use(value), evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def stem(term: Column, language: str = "en") -> Column:
    """The term's stem. English: plurals, past tense, -ing and final y; terms that are short, long or not plain letters stay. See LIGHT for other languages."""
    if language not in ("en", "porter"):
        return F.when(F.length(term) > 4, F.regexp_replace(term, f"({'|'.join(sorted(LIGHT[language].split(), key=len, reverse=True))})$", "")).otherwise(term)

    def plural(x: Column) -> Column:
        return F.when(x.rlike("sses$"), F.regexp_replace(x, "es$", "")).when(x.rlike("ies$"), F.regexp_replace(x, "ies$", "i")).when(x.rlike("ss$"), x).otherwise(F.regexp_replace(x, "s$", ""))

    def tense(x: Column) -> Column:
        return F.when(x.rlike("[aeiou][^aeiou].*eed$"), F.regexp_replace(x, "eed$", "ee")).when(x.rlike("eed$"), x).when(x.rlike(VOWEL + ".*ed$"), mend(F.regexp_replace(x, "ed$", ""))).when(x.rlike(VOWEL + ".*ing$"), mend(F.regexp_replace(x, "ing$", ""))).otherwise(x)

    def mend(cut: Column) -> Column:
        return _let(
            cut,
            lambda x: F.when(x.rlike("(at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike(DOUBLE), F.substring(x, F.lit(1), F.length(x) - 1)).when(x.rlike("^[^aeiou]*[aeiou][^aeiouwxy]$"), F.concat(x, F.lit("e"))).otherwise(x),
        )

    def final(x: Column) -> Column:
        return F.when(x.rlike(VOWEL + ".*y$"), F.regexp_replace(x, "y$", "i")).otherwise(x)

    plain = (F.length(term) > 2) & (F.length(term) < 50) & term.rlike("^[a-z]+$")
    return F.when(plain, _let(_let(plural(term), tense), final)).otherwise(term)


#: Light stemming by the longest suffix, for terms of more than four characters.
LIGHT = {
    "da": "erne erens heden ernes erne eren ene er en et e s",
    "nl": "heden ingen heid end ing en s e",
    "fi": "issa issä ista istä iden ien lla llä lle lta ltä ssa ssä sta stä na nä n t a ä",
    "fr": "issements issement ations ation ements ement euses euse ives ive ités ité ées és ée er es e s",
    "de": "ungen heiten keiten heit keit ung isch lich ern em en er es e s n",
    "hu": "oknak eknek okban ekben ban ben nak nek val vel hoz hez ok ek ak k t",
    "it": "azioni azione amente mente ità ate ati ata ato are ere ire i e a o",
    "no": "hetene heten hets ene ens er en et a e s",
    "pt": "amentos amento ações ação mente idades idade os as es o a e s",
    "ro": "urilor ilor elor ului ul ea ele ii le i e a",
    "ru": "иями ями ами иях ях ах ов ев ей ий ый ой ая яя ое ее ие ые ам ям ом ем а я о е ы и ь",
    "es": "amientos amiento aciones ación mente idades idad os as es o a e s",
    "sv": "heterna heten erna arna orna en et ar er or a e s",
    "tr": "larından lerinden ların lerin ları leri lar ler dan den da de ın in un ün ı i u ü",
}


def drops_single(term: Column) -> Column:
    """Whether the term is a lone letter from b to z, which is left out."""
    return term.rlike("^[b-z]$")


def ngrams(term: Column, low: int = 1, high: int = 4) -> Column:
    """The term's n-grams by length, then place, repeats kept; null for terms of three characters or fewer."""
    of = lambda n: F.when(F.length(term) >= n, F.transform(F.sequence(F.lit(1), F.length(term) - n + 1), lambda i: F.substring(term, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(term) > 3, F.concat(*[of(n) for n in range(low, high + 1)]))


def is_number(term: Column) -> Column:
    return term.rlike("^[0-9]*$")


def server_url(url: Column, root: str = "data/wiki/") -> Column:
    """The URL itself if it is absolute, else a path under the root."""
    return F.when(url.rlike("^http"), url).otherwise(F.concat(F.lit(root), url))


def known_by_md5(name: Column, digests: list[str]) -> Column:
    return F.md5(name.cast("binary")).isin(digests)


def duration(millis: Column) -> Column:
    """HH:mm:ss:SSS."""
    part = lambda unit, size: F.floor(millis / unit) % size
    return F.format_string("%02d:%02d:%02d:%03d", F.floor(millis / 3_600_000), part(60_000, 60), part(1000, 60), millis % 1000)
