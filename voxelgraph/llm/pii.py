"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Validated values (payment cards by their check digit, IBANs by theirs, addresses and dates by range, phone
and social security numbers by shape) are permuted within their own format, so a pseudonym is as valid as
the value it stands for and equal values get equal pseudonyms in every document, however they are spaced.
E-mail names and secrets (hexadecimal ones, keys of known providers, signed tokens) are permuted character by
character within their alphabets; what tells a key's kind stays.

A value is a list of numbers, each below a radix of its own. The network splits the list in two halves and
adds, for eight rounds, a keyed digest of one half to the other, modulo the radices: a permutation of all
lists with these radices. Everything is built from DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.session import table

ROUNDS = 8
#: Dates from 1900-01-01 on, and how many: to the end of 2099. The product of the halves is a little larger.
FIRST_DAY, DAYS, HALF = "date'1900-01-01'", 73_049, 270

#: Where each kind stands. Quantifiers are bounded, so that no text makes a search slow.
FREE, STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Lengths of IBANs by country; a short token behind one is no part of it.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _ibans() -> str:
    """IBANs of their country's length; where none stands, of any length."""
    known = (f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + STOP for n, c in LENGTHS.items())
    return FREE + f"(?:{'|'.join(known)}|[A-Z]{{2}}\\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{STOP})"


#: What must not stand before four numbers, and what must stand before ten plain digits.
BEFORE_IP = r"(?<![\p{L}\p{N}.])(?<!(?i:version|release|build|firmware|ver|v)[ .:]{1,2})"
BEFORE_PLAIN = r"(?<=(?i:phone|tel|call|mobile|fax)[:. ]{1,3})"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "apikey": FREE
    + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[pousr]_[0-9A-Za-z]{36,64}|xox[baprs]-[0-9A-Za-z-]{10,72}|sk-[0-9A-Za-z_-]{20,128}|eyJ[0-9A-Za-z_-]{8,512}\.eyJ[0-9A-Za-z_-]{8,2048}\.[0-9A-Za-z_-]{16,512})"
    + STOP,
    "secret": FREE + r"[0-9a-fA-F]{32,64}" + STOP,
    "iban": _ibans(),
    "card": FREE + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})" + STOP,
    # four numbers behind a word for a version are none
    "ip": BEFORE_IP + r"\d{1,3}(?:\.\d{1,3}){3}(?!\.?[\p{L}\p{N}])",
    "date": FREE + r"(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})" + STOP,
    "ssn": FREE + r"\d{3}-\d{2}-\d{4}" + STOP,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + STOP,
    "abroad": r"(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?(?:\(0?\d{1,4}\)|\d{2,4})){2,5}" + STOP,
    # ten plain digits only behind a word for a telephone
    "plain": BEFORE_PLAIN + r"[2-9]\d{2}[2-9]\d{6}" + STOP,
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A grouped card of 16 digits and a short number behind it, which may belong to it or not.
TAILED = FREE + r"\d{4}(?:[ -]\d{4}){3}[ -]\d{1,3}" + STOP
#: Stands between the two while a text is searched: one of these that the text doesn't have.
MARKS = ("\ufdd0", "\ufdd1", "\ufdd2")
#: What a text must have for any of them.
HINT = r"[0-9]{3}|@|[0-9a-fA-F]{32}|[0-9]\.[0-9]|AKIA|ASIA|AIza|gh[pousr]_|xox[baprs]-|sk-|eyJ"


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(value: str) -> str:
    return f"transform(filter(split({value}, ''), c -> c between '0' and '9'), c -> cast(c as bigint))"


def _refill(value: str, digits: str) -> str:
    """``value`` with its digits replaced, in order."""
    return (
        f"aggregate(split({value}, ''), named_struct('o', '', 'k', 0), (s, c) -> if(c between '0' and '9', "
        f"named_struct('o', concat(s.o, cast({digits}[s.k] as string)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"
    )


def feistel(numbers: str, radices: str, key: str, kind: str) -> str:
    """SQL for the list ``numbers`` permuted among all lists below ``radices``; a single number is shifted by the key."""
    half = f"(size({numbers}) div 2)"
    digest = f"sha2(concat_ws('|', {_lit(key)}, {_lit(kind)}, i, j div 15, array_join(transform(s.b, y -> cast(y as string)), ',')), 256)"
    start = (
        f"named_struct('a', slice({numbers}, 1, {half}), 'b', slice({numbers}, {half} + 1, size({numbers})), "
        f"'ra', slice({radices}, 1, {half}), 'rb', slice({radices}, {half} + 1, size({radices})))"
    )
    added = f"transform(s.a, (x, j) -> (x + cast(conv(substr({digest}, 1 + 4 * (j % 15), 4), 16, 10) as bigint)) % s.ra[j])"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> named_struct('a', s.b, 'b', {added}, 'ra', s.rb, 'rb', s.ra), s -> concat(s.a, s.b))"


def _with(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _luhn(digits: str) -> str:
    """Sum of a card's digits, the last one included; a multiple of ten if they are valid."""
    return f"aggregate(transform(reverse({digits}), (d, p) -> if(p % 2 = 1, if(d > 4, 2 * d - 9, 2 * d), d)), 0L, (s, d) -> s + d)"


def _mod97(text: str) -> str:
    return f"aggregate(split({text}, ''), 0L, (s, c) -> if(c between '0' and '9', (s * 10 + cast(c as bigint)) % 97, (s * 100 + ascii(c) - 55) % 97))"


def _letters(text: str, key: str, kind: str) -> str:
    """Digits, small and capital letters (ASCII) permuted, each within its alphabet; all else as it is."""
    base = "case when c between '0' and '9' then 48 when c between 'a' and 'z' then 97 when c between 'A' and 'Z' then 65 else ascii(c) end"
    radix = "case when c between '0' and '9' then 10L when c between 'a' and 'z' or c between 'A' and 'Z' then 26L else 1L end"
    chars = f"split({text}, '')"
    moved = feistel(f"transform({chars}, c -> cast(ascii(c) - ({base}) as bigint))", f"transform({chars}, c -> {radix})", key, kind)
    return _with(moved, "v", f"array_join(transform({chars}, (c, k) -> if(({radix}) = 1, c, chr(({base}) + v[k]))), '')")


def _card(m: str, key: str) -> str:
    # the first digit (the network) and the check digit stand outside the permutation
    inner = feistel("slice(d, 2, size(d) - 2)", "array_repeat(10L, size(d) - 2)", key, "card")
    body = _with(f"concat(slice(d, 1, 1), {inner})", "e", f"concat(e, array((10 - {_luhn('concat(e, array(0L))')} % 10) % 10))")
    return _with(_digits(m), "d", f"if({_luhn('d')} % 10 = 0, {_with(body, 'f', _refill(m, 'f'))}, null)")


def _iban(m: str, key: str) -> str:
    bare = f"replace({m}, ' ', '')"
    valid = _mod97("concat(substr(t, 5), substr(t, 1, 4))") + " = 1"
    check = "lpad(cast(98 - " + _mod97("concat(u, substr(t, 1, 2), '00')") + " as string), 2, '0')"
    new = _with(_letters("substr(t, 5)", key, "iban"), "u", f"concat(substr(t, 1, 2), {check}, u)")
    spaced = f"aggregate(split({m}, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c = ' ', named_struct('o', concat(s.o, c), 'k', s.k), named_struct('o', concat(s.o, substr(n, s.k, 1)), 'k', s.k + 1)), s -> s.o)"
    return _with(bare, "t", f"if({valid}, {_with(new, 'n', spaced)}, null)")


def _ip(m: str, key: str) -> str:
    octets = f"transform(split({m}, '[.]'), x -> cast(x as bigint))"
    new = f"array_join(transform({feistel('d', 'array(256L, 256L, 256L, 256L)', key, 'ip')}, x -> cast(x as string)), '.')"
    return _with(octets, "d", f"if(forall(d, x -> x < 256), {new}, null)")


def _date(m: str, key: str) -> str:
    first = f"substr({m}, 5, 1) in ('-', '/', '.')"
    bare = f"regexp_replace({m}, '[./]', '-')"
    # a day first, else a month first where that alone is a date
    monthly = f"(not {first} and try_to_date({bare}, 'dd-MM-yyyy') is null)"
    day = f"if({first}, try_to_date({bare}, 'yyyy-MM-dd'), coalesce(try_to_date({bare}, 'dd-MM-yyyy'), try_to_date({bare}, 'MM-dd-yyyy')))"
    once = _with(feistel(f"array(n div {HALF}, n % {HALF})", f"array({HALF + 1}L, {HALF}L)", key, "date"), "p", f"p[0] * {HALF} + p[1]")
    # a number past the last day is permuted again until it is one: still a permutation of the days
    walked = f"aggregate(sequence(1, 16), cast(datediff(t, {FIRST_DAY}) as bigint), (n, w) -> if(w = 1 or n >= {DAYS}, {once}, n))"
    new = f"date_add({FIRST_DAY}, cast({walked} as int))"
    shown = f"if({first}, replace(date_format(z, 'yyyy-MM-dd'), '-', substr({m}, 5, 1)), replace(if({monthly}, date_format(z, 'MM-dd-yyyy'), date_format(z, 'dd-MM-yyyy')), '-', substr({m}, 3, 1)))"
    inside = f"t >= {FIRST_DAY} and t < date_add({FIRST_DAY}, {DAYS})"
    return _with(day, "t", f"if({inside}, {_with(new, 'z', shown)}, null)")


def _ssn(m: str, key: str) -> str:
    parts = f"transform(split({m}, '-'), x -> cast(x as bigint))"
    valid = "d[0] between 1 and 899 and d[0] <> 666 and d[1] > 0 and d[2] > 0"
    new = feistel("array(d[0] - if(d[0] > 666, 2L, 1L), d[1] - 1, d[2] - 1)", "array(898L, 99L, 9999L)", key, "ssn")
    shown = "concat(lpad(cast(e[0] + if(e[0] >= 665, 2L, 1L) as string), 3, '0'), '-', lpad(cast(e[1] + 1 as string), 2, '0'), '-', lpad(cast(e[2] + 1 as string), 4, '0'))"
    return _with(parts, "d", f"if({valid}, {_with(new, 'e', shown)}, null)")


def _phone(m: str, key: str) -> str:
    # the country code stays; area and exchange keep a first digit of the same class (below 2, or 2 to 9)
    tail = f"slice({_digits(m)}, -10, 10)"
    low = "transform(d, (x, p) -> if(p in (0, 3) and x >= 2, 2L, 0L))"
    radices = "transform(d, (x, p) -> if(p in (0, 3), if(x >= 2, 8L, 2L), 10L))"
    moved = feistel("zip_with(d, o, (x, y) -> x - y)", radices, key, "phone")
    new = _with(low, "o", f"zip_with({moved}, o, (x, y) -> x + y)")
    whole = f"concat(slice({_digits(m)}, 1, size({_digits(m)}) - 10), {new})"
    return _with(tail, "d", _with(whole, "f", _refill(m, "f")))


def _abroad(m: str, key: str) -> str:
    # the country code stays: the digits up to the first mark, two where there is none
    code = f"coalesce(nullif(length(regexp_extract({m}, '^[+]([0-9]{{1,3}})[^0-9]', 1)), 0), 2)"
    moved = feistel("t", "array_repeat(10L, size(t))", key, "phone")
    body = _with(f"slice(d, {code} + 1, size(d) - {code})", "t", _with(f"concat(slice(d, 1, {code}), {moved})", "f", _refill(m, "f")))
    return _with(_digits(m), "d", f"if(size(d) between 8 and 15, {body}, null)")


def _apikey(m: str, key: str) -> str:
    kind = f"regexp_extract({m}, '^(AKIA|ASIA|AIza|gh[pousr]_|xox[baprs]-|sk-|eyJ)', 1)"
    return _with(kind, "h", f"concat(h, {_letters(f'substr({m}, length(h) + 1)', key, 'apikey')})")


def _secret(m: str, key: str) -> str:
    values = f"transform(split(lower({m}), ''), c -> cast(conv(c, 16, 10) as bigint))"
    moved = feistel(values, f"array_repeat(16L, length({m}))", key, "secret")
    text = f"array_join(transform({moved}, v -> substr('0123456789abcdef', cast(v + 1 as int), 1)), '')"
    # hexadecimal without a letter is left to the number rules
    return f"if({m} rlike '[a-fA-F]' and {m} rlike '[0-9]', if({m} = upper({m}), upper({text}), {text}), null)"


def _email(m: str, key: str) -> str:
    return f"concat({_letters(f'substring_index({m}, chr(64), 1)', key, 'email')}, chr(64), substring_index({m}, chr(64), -1))"


RULES = {"email": _email, "apikey": _apikey, "secret": _secret, "iban": _iban, "card": _card, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "plain": _phone}
#: What some kinds are called in the results.
CALLED = {"abroad": "phone", "plain": "phone", "apikey": "secret"}


def pseudonym(value: str, key: str) -> str:
    """SQL for ``struct<kind, value>``: what a match becomes; a null kind for one that isn't valid."""
    none = "named_struct('kind', cast(null as string), 'value', cast(null as string))"

    def tried(kind: str, rule) -> str:
        # the rule is computed once, and only for what has its shape; what stands around a match is not in it
        shape = _lit(f"^(?:{PATTERNS[kind].removeprefix(BEFORE_PLAIN).removeprefix(BEFORE_IP)})$")
        named = f"if(z is null, null, named_struct('kind', '{CALLED.get(kind, kind)}', 'value', z))"
        return f"if({value} rlike {shape}, {_with(rule(value, key), 'z', named)}, null)"

    return f"coalesce({', '.join(tried(kind, rule) for kind, rule in RULES.items())}, {none})"


def _marked(text: str) -> str:
    """SQL for the text with its mark between each card and a number behind it that isn't the card's.

    The longest card counts; where its check fails, the 16 digits before the last group do if theirs holds.
    """
    valid = lambda m: f"{_luhn(_digits(m))} % 10 = 0"
    cut = f"if(not {valid('m')} and {valid('substr(m, 1, 19)')}, concat(substr(m, 1, 19), {_mark(text)}, substr(m, 20)), m)"
    found = f"transform(regexp_extract_all({text}, {_lit(TAILED)}, 0), m -> {cut})"
    return f"if({text} rlike {_lit(TAILED)}, array_join(flatten(zip_with(split({text}, {_lit(TAILED)}, -1), {found}, (a, b) -> array(a, coalesce(b, '')))), ''), {text})"


def _mark(text: str) -> str:
    return "case " + " ".join(f"when instr({text}, '{m}') = 0 then '{m}'" for m in MARKS) + " else '' end"


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii_kinds``: the kinds found, in order of the text.

    Equal values have equal pseudonyms under one ``key``, in all documents; whoever has the key can undo them,
    so it has no default. Values that fail their check (a card number's last digit, an octet over 255, a day
    that doesn't exist) are no personal data and stay, as does all other text, and letters beyond ASCII in the
    name of an e-mail address. A null text stays null, with no kinds; repeated rows change alike; texts are
    searched whole; an empty table gives no rows. A column ``pii_kinds`` is replaced, all others are kept
    under any names.
    """
    names = [c for c in docs.columns if c != "pii_kinds"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(text).alias("text"))
    found = F.when(F.col("text").rlike(HINT), F.expr(f"regexp_extract_all(text, {_lit(PATTERN)}, 0)"))
    marked = rows.select("row", F.expr(f"if(text rlike {_lit(TAILED)}, {_mark('text')}, '')").alias("mark"), F.expr(_marked("text")).alias("text"))
    at = marked.select("row", "mark", "text", found.alias("found"))
    new = F.when(F.size("found") > 0, F.expr(f"transform(found, m -> {pseudonym('m', key)})"))
    parts = at.withColumn("new", new).withColumn("parts", F.when(F.size("new") > 0, F.expr(f"split(text, {_lit(PATTERN)}, -1)")))
    joined = "array_join(concat(transform(new, (x, k) -> concat(parts[k], coalesce(x.value, found[k]))), array(parts[size(new)])), '')"
    kinds: Column = F.expr("array_compact(transform(new, x -> x.kind))")
    return parts.select(
        *(F.expr(f"replace(coalesce({joined}, text), mark, '')").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in names),
        F.coalesce(kinds, F.array().cast("array<string>")).alias("pii_kinds"),
    )


#: The key of the registered query; a user passes one of their own.
QUERY_KEY = "key of the registered query"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with pseudonyms for the personal data in their whole texts."""
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY).select("doc_id", "text", F.size("pii_kinds").alias("n_found"), F.array_join("pii_kinds", ",").alias("kinds"))
