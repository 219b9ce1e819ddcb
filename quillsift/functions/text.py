"""Text functions as Column builders; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded to plain ones. Letterlike symbols, small capitals, Cyrillic, Greek.
CONFUSABLE_FROM = "ℎℬℰℱℋℐℒℳℯℊℴℭℌℑℜℨℂℍℕℙℚℝℤ" + "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢ" + "аеорсхуѕіјАВЕКМНОРСТХУ" + "ορανΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
CONFUSABLE_TO = "hbefhilmegochirzchnpqrz" + "abcdefghijklmnoprtuvwyz" + "aeopcxysijabekmhopctxy" + "opavabezhikmnoptyx"
# Where the mathematical alphabets (A-Z a-z) and figures (0-9) begin.
MATH_LETTERS = (0x1D400, 0x1D434, 0x1D468, 0x1D49C, 0x1D4D0, 0x1D504, 0x1D538, 0x1D56C, 0x1D5A0, 0x1D5D4, 0x1D608, 0x1D63C, 0x1D670)
MATH_DIGITS = (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
# Brands, and second-level labels that belong to the suffix in front of a country code.
BRANDS = (
    "apple paypal aldi coles woolworths netflix amazon microsoft google anz nab commbank westpac auspost linkt telstra "
    "optus mygov medicare ato facebook instagram ebay kmart bunnings qantas suncorp bupa unisuper dhl fedex norton "
    "mcafee binance coinbase outlook office365"
).split()
SECOND_LEVEL = "com net org edu gov co ac asn id or ne go gen mil biz info".split()

WORD_BREAK = r"[^\p{IsAlphabetic}\p{N}._@-]+"
_MATH_FROM = "".join(chr(s + i) for s in MATH_LETTERS for i in range(52)) + "".join(chr(s + i) for s in MATH_DIGITS for i in range(10))
_MATH_TO = ("abcdefghijklmnopqrstuvwxyz" * 2) * len(MATH_LETTERS) + "0123456789" * len(MATH_DIGITS)
FOLD_FROM, FOLD_TO = CONFUSABLE_FROM + _MATH_FROM, CONFUSABLE_TO + _MATH_TO


def words(text: Column) -> Column:
    """The words of a text in order: split at anything but letters, figures and ``. - _ @``, ends trimmed, lower case."""
    w = F.transform(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda x: F.lower(F.btrim(x, F.lit(".-_"))))
    return F.filter(w, lambda x: x != "")


def valid(w: Column, low: int = 3, high: int = 40) -> Column:
    """Lengths count bytes."""
    return F.octet_length(w).between(low, high)


def valid_words(text: Column, low: int = 3, high: int = 40) -> Column:
    return F.filter(words(text), lambda w: valid(w, low, high))


def bigrams(ws: Column) -> Column:
    """Neighbouring words joined by ``_``."""
    n = F.size(ws)
    return F.when(n >= 2, F.zip_with(F.slice(ws, F.lit(1), n - 1), F.slice(ws, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(
        F.array().cast("array<string>")
    )


def fold(w: Column) -> Column:
    """A word with look-alike letters replaced, or NULL if none was, or if other than ASCII is left."""
    f = F.translate(w, FOLD_FROM, FOLD_TO)
    return F.when((f != w) & f.rlike(r"^[\x00-\x7F]*$"), f)


def is_mixed_script(w: Column) -> Column:
    """ASCII letters beside Cyrillic, Greek or Armenian ones."""
    return w.rlike("[A-Za-z]") & w.rlike("[\\x{0400}-\\x{04FF}\\x{0370}-\\x{03FF}\\x{0530}-\\x{058F}]")


def word_tokens(ws: Column, prefix: str, homoglyphs: bool = False, low: int = 3, high: int = 40) -> Column:
    """Prefixed words; with ``homoglyphs`` also folded words and their flags."""
    plain = F.transform(ws, lambda w: F.concat(F.lit(prefix), w))
    if not homoglyphs:
        return plain
    more = F.transform(
        ws,
        lambda w: F.array(
            F.when(fold(w).isNotNull() & valid(fold(w), low, high), F.concat(F.lit(prefix), fold(w))),
            F.when(fold(w).isNotNull(), F.lit("x:confusable")),
            F.when(~w.rlike(r"^[\x00-\x7F]*$") & is_mixed_script(w), F.lit("x:mixedscript")),
        ),
    )
    return F.concat(plain, F.array_compact(F.flatten(more)))


def canonical(s: Column) -> Column:
    """A word for comparing brands: look-alikes in ASCII folded, nothing but letters and figures kept."""
    return F.regexp_replace(F.translate(F.lower(s), "il1|053", "llllose"), "[^a-z0-9]", "")


_BRAND_FORMS = list(dict.fromkeys(b.translate(str.maketrans("il1|053", "llllose")) for b in BRANDS))


def claimed_brand(name: Column) -> Column:
    """The first word of a display name that is a brand, in canonical form."""
    ws = F.split(F.translate(name, FOLD_FROM, FOLD_TO), r"[^\p{IsAlphabetic}\p{N}]+")
    named = F.filter(F.transform(F.filter(ws, lambda w: w != ""), canonical), lambda w: w.isin(_BRAND_FORMS))
    return F.try_element_at(named, F.lit(1))


def _labels(host: Column) -> Column:
    return F.filter(F.split(host, r"\."), lambda x: x != "")


def _is_ip(host: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return host.rlike(rf"^(?:{octet}\.){{3}}{octet}$") | host.contains(":")


def _suffix_labels(labels: Column) -> Column:
    """How many labels the public suffix has."""
    n = F.size(labels)
    two = (n >= 3) & (F.octet_length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(n >= 2, F.lit(-2)).otherwise(F.lit(-1))).isin(SECOND_LEVEL)
    return F.when(two, 2).otherwise(1)


def decompose_host(host: Column) -> Column:
    """``registrable`` domain and bare ``brand`` of a host; NULL for addresses and single labels."""
    labels = _labels(host)
    n, k = F.size(labels), _suffix_labels(labels)
    usable = host.isNotNull() & ~_is_ip(host) & (n >= 2)
    own = F.when(usable, F.slice(labels, n - k, k + 1))
    return F.when(usable, F.struct(F.array_join(own, ".").alias("registrable"), F.element_at(own, 1).alias("brand")))


def effective_tld(host: Column) -> Column:
    labels = _labels(host)
    n, k = F.size(labels), _suffix_labels(labels)
    usable = host.isNotNull() & ~_is_ip(host) & (n >= 2)
    return F.when(usable, F.array_join(F.slice(labels, F.when(usable, n - k + 1).otherwise(F.lit(1)), k), "."))


def normalize_url(url: Column, max_len: int = 40) -> Column:
    """Lower case, without query and fragment, cut to ``max_len`` bytes at a character."""
    u = F.regexp_replace(F.lower(url), r"(?s)[?#].*$", "")
    cut = F.make_valid_utf8(F.substring(F.encode(u, "UTF-8"), 1, max_len).cast("string"))
    return F.when(F.octet_length(u) <= max_len, u).otherwise(F.regexp_replace(cut, "�$", ""))


def urls_of_html(html: Column, max_len: int = 40) -> Column:
    """Addresses of quoted ``href`` and ``src`` attributes, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?s)(?:href|src)=(['\"])(https?://.*?)\1"), F.lit(2))
    return F.transform(found, lambda u: normalize_url(u, max_len))


def urls_of_text(text: Column, max_len: int = 40) -> Column:
    """Addresses standing in plain text, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s\"'<>)\]|]+"), F.lit(0))
    return F.transform(found, lambda u: normalize_url(u, max_len))


def strip_html(html: Column) -> Column:
    """Text of an HTML part: scripts, styles, comments and heads dropped, tags to blanks, common entities decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return t


def auth_tokens(header: Column) -> Column:
    """``x:auth:method_result`` for spf, dkim and dmarc."""
    h = F.lower(header)
    found = [F.regexp_extract(h, f"{m}=([a-z]*)", 1) for m in ("spf", "dkim", "dmarc")]
    return F.array_compact(F.array(*(F.when(v != "", F.concat(F.lit(f"x:auth:{m}_"), v)) for m, v in zip(("spf", "dkim", "dmarc"), found))))


def spf_token(header: Column) -> Column:
    v = F.lower(F.regexp_extract(header, r"^\s*([A-Za-z]+)", 1))
    return F.when(v != "", F.concat(F.lit("x:spf:"), v))


def address_tokens(prefix: str, address: Column, low: int = 3, high: int = 40, tld: bool = False) -> Column:
    """Address, domain, registrable domain, brand and, if asked for, suffix of a mail address."""
    a = F.lower(address)
    domain = F.when(F.instr(a, "@") > 0, F.try_element_at(F.split(a, "@"), F.lit(2)))
    parts = decompose_host(domain)
    p = F.lit(prefix)
    out = [
        F.when(valid(a, low, high), F.concat(p, a)),
        F.when(valid(domain, low, high), F.concat(p, domain)),
        F.when((parts["registrable"] != domain) & valid(parts["registrable"], low, high), F.concat(p, parts["registrable"])),
        F.when(valid(parts["brand"], 2, 40), F.concat(p, parts["brand"])),
    ]
    if tld:
        out.append(F.concat(F.lit("x:tld:"), effective_tld(domain)))
    return F.array_compact(F.array(*out))


def name_tokens(name: Column, address: Column, homoglyphs: bool = False, low: int = 3, high: int = 40) -> Column:
    """Words of a display name, and ``x:brandmiss:`` where it claims a brand that its domain isn't."""
    ws = valid_words(name, low, high)
    domain = F.try_element_at(F.split(F.lower(address), "@"), F.lit(2))
    own = canonical(decompose_host(domain)["brand"])
    claimed = claimed_brand(name)
    miss = F.when(claimed.isNotNull() & ~F.coalesce(F.contains(own, claimed), F.lit(False)), F.concat(F.lit("x:brandmiss:"), claimed))
    return F.concat(word_tokens(ws, "h:fromname:", homoglyphs, low, high), F.array_compact(F.array(miss)))
