"""Code-point classes, as regex fragments that Java, Python and RE2 read alike.

The five script classes differ on purpose; operators name the one they use.
"""

# Code-point ranges.
ARABIC_FULL_BOM = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
ARABIC_FULL = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFE}"
ARABIC_THREE = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"
ARABIC_BASIC = r"\x{0600}-\x{06FF}"
LATIN_WIDE = r"a-zA-Z\x{00C0}-\x{024F}"
LATIN_BASIC = "a-zA-Z"
TACHKIL = r"\x{064B}-\x{065F}\x{0670}"
ZERO_WIDTH = r"\x{200B}\x{200C}\x{200E}\x{200F}\x{2066}-\x{2069}\x{FEFF}"
ZWJ, VS16, TATWEEL = r"\x{200D}", r"\x{FE0F}", r"\x{0640}"
EMOJI = r"\x{1F300}-\x{1F5FF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}"
WORD = r"[\p{L}\p{N}_]"
GRAPHEME = f"[{EMOJI}]{VS16}?(?:{ZWJ}[{EMOJI}]{VS16}?)*"
PUNCTUATION = ("!", r"\?", r"\x{061F}", ",", r"\x{060C}")
#: What counts as blank at a text's ends.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
