"""Personal data: validated numbers and dates become keyed, format-preserving Feistel pseudonyms.

A value of a format with a x b members is split into a left part below a and a right part below b; rounds add a keyed
digest of one part to the other, modulo its size. That is a permutation of the format for any a and b, so equal values get
equal pseudonyms in all documents, different ones stay different, and the key holder can undo it. Everything is a SQL
expression over the matches of one pattern; texts without a digit or @ are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DEFAULT_KEY = "change-me"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*+\.[A-Za-z0-9])++[A-Za-z0-9-]*+"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
ISO_DATE = r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
DAY_DATE = r"(?<![\d/.])(?:0[1-9]|[12]\d|3[01])[/.](?:0[1-9]|1[0-2])[/.](?:19|20)\d\d(?![\d/])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d{4}(?:([ -])\d{4}\1\d{4}\1\d{1,7}|\d{9,15})(?!\d)"
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])"
ANY = "|".join([EMAIL, SECRET, IP, ISO_DATE, DAY_DATE, SSN, PHONE, CARD])

#: Days from 1900-01-01 to 2099-12-31, as a product of two whole numbers.
DAYS_LEFT, DAYS_RIGHT = 17, 4297


def _digest(key: str, kind: str, round_no: str, value: str) -> str:
    """SQL for 48 keyed bits as a non-negative long."""
    secret = key.replace("\\", "\\\\").replace("'", "\\'")
    return (f"cast(conv(substr(sha2(concat('{secret}', '|{kind}|', {round_no}, '|', {value}), 256), 1, 12), 16, 10) as bigint)")


def feistel(value: str, left: str, right: str, kind: str, key: str, undo: bool = False) -> str:
    """SQL that permutes `value`, a number below left * right; `undo` gives the inverse.

    The rounds are a fold over their numbers: written out one inside another, they cost the driver hundreds of MB to parse.
    """
    sign = "-" if undo else "+"
    numbers = ", ".join(str(i) for i in (reversed(range(ROUNDS)) if undo else range(ROUNDS)))

    def moved(part: str, other: str, size: str) -> str:
        return f"pmod(s.{part} {sign} {_digest(key, kind, 'cast(k as string)', f'cast(s.{other} as string)')} % ({size}), {size})"
    return (f"aggregate(array({numbers}), named_struct('l', {value} div ({right}), 'r', {value} % ({right})), (s, k) -> if(k % 2 = 0, "
            f"named_struct('l', {moved('l', 'r', left)}, 'r', s.r), named_struct('l', s.l, 'r', {moved('r', 'l', right)})), "
            f"s -> s.l * ({right}) + s.r)")


def _power(n: str) -> str:
    return f"cast(rpad('1', cast({n} as int) + 1, '0') as bigint)"


def digits(value: str, kind: str, key: str, undo: bool = False) -> str:
    """SQL that permutes a string of up to 18 digits among those of its length."""
    left, right = _power("length(d) div 2"), _power("length(d) - length(d) div 2")
    moved = feistel("cast(d as bigint)", left, right, kind, key, undo)
    return f"transform(array({value}), d -> lpad(cast({moved} as string), length(d), '0'))[0]"


def luhn_sum(value: str) -> str:
    """SQL for the Luhn sum of a digit string, its last digit undoubled."""
    return (f"aggregate(transform(split(reverse({value}), ''), (c, i) -> cast(c as int) * (1 + i % 2)), 0, "
            f"(a, x) -> a + if(x > 9, x - 9, x))")


def card_number(value: str, key: str, undo: bool = False) -> str:
    """SQL for 13 to 19 digits: Luhn-valid ones keep a valid check digit, others are permuted as a whole."""
    body = digits("substr(v, 1, length(v) - 1)", "card", key, undo)
    valid = f"transform(array({body}), b -> concat(b, cast(pmod(-({luhn_sum("concat(b, '0')")}), 10) as string)))[0]"
    # 19 digits do not fit the long of the digit permutation: their first digit stays
    other = f"if(length(v) <= 18, {digits('v', 'account', key, undo)}, concat(substr(v, 1, 1), {digits('substr(v, 2)', 'account', key, undo)}))"
    return f"transform(array({value}), v -> if({luhn_sum('v')} % 10 = 0, {valid}, {other}))[0]"


def pseudonym(key: str = DEFAULT_KEY, undo: bool = False) -> str:
    """SQL for the pseudonym of one match `m` of ANY.

    Digits are permuted among the match's digit places, so separators and brackets stay where they are. Emails get a
    keyed name of the same domain depth; secrets get keyed hexadecimal digits of the same length. These two have no
    closed format to permute: they stay linked, but cannot be undone.
    """
    only = "regexp_replace(m, '[^0-9]', '')"
    ip_number = "aggregate(split(m, '[.]'), 0L, (a, x) -> a * 256 + cast(x as bigint))"
    ip = (f"transform(array({feistel(ip_number, '65536', '65536', 'ip', key, undo)}), x -> concat_ws('.', "
          "x div 16777216, x div 65536 % 256, x div 256 % 256, x % 256))[0]")
    day = "datediff({}, date'1900-01-01')"

    def dated(parsed: str, fmt: str) -> str:
        """Days that the calendar lacks are kept."""
        moved = feistel(f"cast({day.format(parsed)} as bigint)", str(DAYS_LEFT), str(DAYS_RIGHT), "date", key, undo)
        return f"coalesce(date_format(date_add(date'1900-01-01', cast({moved} as int)), '{fmt}'), m)"

    iso = dated("try_to_date(m, 'yyyy-MM-dd')", "yyyy-MM-dd")
    slash, dot = (dated(f"try_to_date(m, 'dd{c}MM{c}yyyy')", f"dd{c}MM{c}yyyy") for c in "/.")
    local = f"sha2(concat('{key}', '|email|', lower(m)), 256)"
    email = f"concat('u', substr({local}, 1, 12), '@', substr({local}, 13, 8), '.', regexp_extract(m, '([A-Za-z0-9-]+)$', 1))"
    secret = f"substr(concat(sha2(concat('{key}', '|secret|', m), 256), sha2(concat('{key}', '|secret2|', m), 256)), 1, length(m))"
    country = "regexp_extract(m, '^([+][0-9]{1,3}(?=[ .(-]))', 1)"
    # (country part, local digits) of a phone number, and the national separators
    tail = f"substr(m, length({country}) + 1)"
    phone = ("transform(array(" + digits(f"regexp_replace({tail}, '[^0-9]', '')", "phone", key, undo) + "), "
             f"n -> concat({country}, " + _refill(tail, "n") + "))[0]")
    ssn = f"transform(array({digits(only, 'ssn', key, undo)}), n -> {_refill('m', 'n')})[0]"
    card = f"transform(array({card_number(only, key, undo)}), n -> {_refill('m', 'n')})[0]"
    cases = [("m like '%@%'", email), (f"m rlike '^{_sql(SECRET)}$'", secret), (f"m rlike '^{_sql(IP)}$'", ip),
             ("m rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'", iso), ("m rlike '^[0-9]{2}/[0-9]{2}/[0-9]{4}$'", slash),
             ("m rlike '^[0-9]{2}[.][0-9]{2}[.][0-9]{4}$'", dot), ("m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", ssn),
             (f"m rlike '^(?:{_sql(PHONE)})$'", phone)]
    return "case " + " ".join(f"when {c} then {x}" for c, x in cases) + f" else {card} end"


def _refill(shape: str, numbers: str) -> str:
    """SQL that puts the digits of `numbers` into the digit places of `shape`, in order."""
    return (f"aggregate(split({shape}, ''), named_struct('o', '', 'i', 1), (a, c) -> if(c between '0' and '9', "
            f"named_struct('o', concat(a.o, substr({numbers}, a.i, 1)), 'i', a.i + 1), "
            "named_struct('o', concat(a.o, c), 'i', a.i)), a -> a.o)")


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def replaced(text: str, key: str = DEFAULT_KEY, undo: bool = False) -> Column:
    """The text with every match replaced; null stays null."""
    any_sql = _sql(ANY)
    pieces = (f"transform(array(named_struct('p', split({text}, '{any_sql}', -1), 'm', regexp_extract_all({text}, '{any_sql}', 0))), "
              f"x -> array_join(flatten(transform(x.p, (p, i) -> array(p, coalesce(transform(array(get(x.m, i)), m -> "
              f"{pseudonym(key, undo)})[0], '')))), ''))[0]")
    return F.expr(f"case when {text} rlike '[0-9@]' then {pieces} else {text} end")


def pseudonymise(documents: DataFrame, key: str = DEFAULT_KEY, undo: bool = False) -> DataFrame:
    """The documents with personal data in `text` replaced by pseudonyms of the same format; n_chars follows the text.

    Found are emails, IPv4 addresses, phone numbers, calendar dates from 1900 to 2099, 3-2-4 identity numbers, account
    and card numbers of 13 to 19 digits, and hexadecimal secrets of 32 to 64 characters. Out-of-range addresses and days
    that no calendar has are left alone. Null and empty texts, all other columns and repeated rows stay as they are.
    A n_chars column, if there is one, is counted anew where the text is not null.
    """
    out = documents.withColumn("text", replaced("`text`", key, undo))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(documents.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in documents.columns])
