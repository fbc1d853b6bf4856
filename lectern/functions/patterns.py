"""Patterns and word lists the line rules are made of, in the subset of syntax that Java, RE2 and Python share.

Fixed values: they define what counts as a page heading, a date, a title and so on.
"""

MONTHS_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTHS_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
WEEKDAYS = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
DAY_ENDINGS = "th|st|nd|rd"
SPAN_TITLES = "mr|bw|ms|bi|hon|capt|mrs|dr|prof|gen|maj-gen|maj|major|an hon|a hon|eng|engineer|col|rtd|rev|sen|mheshimiwa"
NAME_TITLES = r"mr|bw|ms|bi|hon|capt|mrs|dr|prof|gen|maj[-\s.]+gen|maj|major|an hon|a hon|eng|engineer|col|rtd|rev|sen|bishop|mheshimiwa"

STRIP = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
PUNCT = r"[!-/:-@\[-`{-~]"
LINE_BREAKS = r"[\n\r]+"
RAW_BREAKS = r"\r\n|\r|\n"

PAGE_NUMBER = r"^[0-9]{1,4}\z"
PAGE_HEADING = r"^PARLI(?:A)?(?:M)?E(?:A)?NTARY(?: )?(?:L)?DEBATE(?:S)?\z"
TRANSCRIPT_HEADING = r"^\s*(?:NATIONAL ASSEMBLY)*\s*(?:OFFICIAL REPORT)*\s*\z"
PAGE_FOOTER = (
    r"^Disclaimer:\s+The\s+electronic\s+version\s+of\s+the"
    r"|Official\s+Hansard\s+Report\s+is\s+for\s+information\s+purposes"
    r"|A\s+certified\s+version\s+of\s+this\s+Report\s+can\s+be\s+obtained\s+from\s+the\s+Hansard\s+Editor\.\z"
)
LONG_DATE = rf"^[A-z]{{1,12}}[\s,]{{1,4}}\d{{1,2}}\s{{0,2}}(?:{DAY_ENDINGS})[\s,]{{1,4}}(?:{MONTHS_LONG})[\s,]{{1,4}}\d{{4}}"
PAGE_DATES = (
    rf"^(?:{WEEKDAYS})[\s,]{{1,5}}\d+\z",
    rf"^(?:{MONTHS_LONG}|{MONTHS_SHORT})[\s,]{{1,5}}\d+\z",
    rf"^(?:{MONTHS_LONG}|{MONTHS_SHORT})\s*\d{{1,2}},*\s*\d{{4}}",
    rf"(?:{MONTHS_LONG}|{MONTHS_SHORT})\s*\d{{1,2}},*\s*\d{{4}}\z",
    rf"\d{{0,4}}\s*(?:{WEEKDAYS}),\s*\d{{1,2}}[A-z]{{1,2}}\s*(?:{MONTHS_LONG}|{MONTHS_SHORT}),\s*\d{{4}}",
    rf"^(?:{DAY_ENDINGS})\z",
)
SUBHEADER = r"(?i)^first reading|^second reading|^question no|^no[.,]\s*\d{1,4}\z"
SUBSUBHEADER = (
    r"(?i)^(?:n\s?e\s?w\s*)?c\s?l\s?a\s?u\s?s\s?e|^division\z|^noes\z|^ayes\z"
    r"|^(?:sub-?)?\s*vote\s*[dr]?\d+|^head\s*[dr]?\d+"
    r"|^(?:new\s*)?(?:first|second|third|fourth|fifth|sixth) schedule\z|^schedule\s*\d+\z"
)
BRACKETED = r"(?s)^[(\[].+[)\]]\z"
OVERRIDE_SIGNS = r"^[\s\d!-/:-@\[-`{-~]+\z"

_TAG = r"[/\s]{0,3}(?:new[-\s]?spe{1,2}ch|spe{1,2}ch|sub[-\s]?heade?r|heade?r|scene?|district|i|b|u)[/\s]{0,3}"
TAGS = rf"(?i)<{_TAG}>|<{_TAG}|{_TAG}>"
TAG_NOISE = r"[</>\s-]"

SEGUE = r"^\s*(?::|said|asked|ali|to ask)"
SEGUE_ANY = r"(?i)^\s*(?::|said|asked|ali|to ask)"
SPAN_PLAIN = r"(?is)^(\s*)([A-z()., '-]{3,100}):"
SPAN_TITLED = rf"(?is)^(\s*)((?:{SPAN_TITLES})[. ]{{1,2}}[A-z()., '-]{{3,40}})(?::| said| asked| ali| to ask)"
COLONS = r"\s*:\s*"
GLUE_OFFICE = r"(?i)^the.+minister|^assistant.+minister|^minister|^the.+speaker|^temporary.+speaker"

NAME_PARTS = (
    # title, second title and name, maybe in brackets
    (rf"(?is)^(?:[(\[])?(?:({NAME_TITLES})[.\s]+)?\s*(?:\(\s*({NAME_TITLES})[.\s]*\))?\s*([0-9A-z'.,\s-]{{3,100}})\s*(?:[)\]])?\z", {"title": 1, "title2": 2, "name": 3}),
    # an office, then title and name in brackets
    (rf"(?is)^([0-9A-z',\s-]{{5,}})\((?:\s*({NAME_TITLES})[.\s]+)?\s*(?:\(\s*({NAME_TITLES})[.\s]*\))?\s*([0-9A-z'.,\s-]{{3,100}})\)\s*\z", {"appt": 1, "title": 2, "title2": 3, "name": 4}),
    # title and name, then an office in brackets
    (rf"(?is)^({NAME_TITLES})[.\s]+(?:\(\s*({NAME_TITLES})[.\s]*\))?\s*([0-9A-z'.,\s-]{{3,100}})\s*\(\s*([0-9A-z',.\s/-]{{5,}})\s*\)\s*\z", {"title": 1, "title2": 2, "name": 3, "appt": 4}),
    # an office alone
    (r"(?is)^\s*([0-9A-z',.\s/-]{5,})\s*\z", {"appt": 1}),
)
OFFICE_WORDS = r"(?i)speaker|minister|members"

_DAYS = "|".join(str(d) for d in (*range(10, 32), *range(1, 10)))
_YEARS = r"19\d\d|20\d\d"
_M = f"{MONTHS_LONG}|{MONTHS_SHORT}"
#: (pattern, groups of day, month, year), in order of preference.
SITTING_DATES = (
    (rf"(?is)(?:{WEEKDAYS})[\s,]*({_DAYS})[\s.,]*(?:{DAY_ENDINGS})?[\s.,]*({_M})[\s,]*({_YEARS})", (1, 2, 3)),
    (rf"(?is)(?:{WEEKDAYS})[\s,]*({_M})[\s,]*({_DAYS})[\s.,]*(?:{DAY_ENDINGS})?[\s.,]*({_YEARS})", (2, 1, 3)),
    (rf"(?is)({_M})[\s,]*({_DAYS})[\s.,]*(?:{DAY_ENDINGS})?[\s.,]*({_YEARS})", (2, 1, 3)),
    (rf"(?is)({_DAYS})[\s.,]*(?:{DAY_ENDINGS})?[\s.,]*({_M})[\s,]*({_YEARS})", (1, 2, 3)),
)
HOUSE_TIME = r"(?i)the\s*house\s*{action}\s*at\s*(\d{{1,2}})[.:;](\d{{1,2}})\s*([ap]\.?m\.?)"
WINDOW, WINDOWS = 100, 14

LABEL_CODES = {"header": 0, "speech": 1, "scene": 2, "garbage": 3}
CONTEXT_LINES, MAX_CHARS, UPSAMPLE, UPSAMPLE_SEED, SPLIT_PASSES = 4, 2048, 10, 933707, 2
