"""Patterns and small tables of the contract language.

All of these are fixed values: results depend on their exact form.  They are written in Java's dialect where Spark
runs them and in Python's where an Arrow function does; where both hold, the text is the same.  Case is ignored where
a name says so by ``(?i)`` at the point of use.
"""

from __future__ import annotations

import string

# -- characters
CJK = r"[一-鿿]"
SYMBOLS = ["●", "•", "·", "∙", "◉", "○", "⦿", "。", "■", "□", "☐", "⁃", "◆", "◇", "◈", "✦", "➢", "➣", "➤", "‣", "▶", "▷", "❖", "_"]
PUNCTUATION = string.punctuation
KEPT_PUNCTUATION = r"():,.\$"  # what the light clean-up leaves in

# -- splitting paragraphs into phrases
PARA_SPLIT = r"( and/or;| ; and/or|; and/or|;and/or|; and then| and;| ; and|; and|;and| or;| ; or|; or|;or|; plus|;plus|;)"
COMMA_DELIMITERS = r"((?<!\d{3}),(?! \bwhich\b)(?! \band\b)(?! \bincluding\b)(?! etc.)|(?<!\blaws\b) and | or (?!\botherwise\b)|not limited to)"
SPLIT_AT_COMMA = ["Documentation", "Amendments and Waivers", "Miscellaneous Provisions", "Other Terms", "Undertakings and Other Terms", "Other Terms and Conditions"]
SPLIT_WHEN_LONG = ["Documentation", "Undertakings", "General Undertaking", "Other Covenants & Undertaking", "Other Undertakings", "General Covenants", "Covenants", "Covenants / Undertakings", "Covenants and Undertakings", "Representations", "Events of Default"]

# -- headings
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
SMALL_ROMANS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"]
ROMAN = r"[MDCLXVI]+"
NOT_A_HEADING = r"\!\#\$\%\&\'\(\)\+\,\/\:\;\<\=\>\?\@\\\]\^\_\`\~\.\s\d"
SCHEDULE_DIGIT = r"^S\s*CHEDULE\s*(\d+)\s*(.*)"
SCHEDULE_ROMAN = rf"^S\s*CHEDULE\s*({ROMAN})\s*(.*)"
SCHEDULE_ORDINAL = rf"^THE ({'|'.join(ORDINALS)}) SCHEDULE [a-zA-Z]+ REFERRED TO\s*(.*)"
SCHEDULE_ORDINAL_2 = rf"THE ({'|'.join(ORDINALS)}) SCHEDULE:*\s*-*(.*)"
PART_DIGIT = r"^P\s*ART\s(\d+):*\s*-*(.*)"
PART_ROMAN = rf"^P\s*ART\s({ROMAN}):*\s*-*(.*)"
PART_ALPHA = r"^P\s*ART\s([a-zA-Z]):*\s*-*(.*)"
SECTION_WORD = r"^SECTION\s*(\d*[a-zA-Z]*)(.*)(\d+[a-zA-Z]*)\.*(.*)\n*"
CLAUSE_AND_TITLE = (
    r"(^\d{1,2}[a-zA-Z]+)\s*" + rf"([^{NOT_A_HEADING}].*)|"
    r"(^\d{1,2}[a-zA-Z]+)\.(\d{0,2}\.*\d{0,2}\.*\d{0,2})\s*" + rf"([^{NOT_A_HEADING}].*)|"
    r"(^\d{1,2})\s*" + rf"([^{NOT_A_HEADING}].*)|"
    r"(^\d{1,2})\.(\d{0,2}\.*\d{0,2}\.*\d{0,2})\s*" + rf"([^{NOT_A_HEADING}].*)"
)
CLAUSE_ALONE = r"(^\d{1,2}[a-zA-Z]+)\s*$|(^\d{1,2}[a-zA-Z]+)\.(\d{0,2}\.*\d{0,2}\.*\d{0,2})\s*$|(^\d{1,2})\s*$|(^\d{1,2})\.(\d{0,2}\.*\d{0,2}\.*\d{0,2})\s*$"
SECTION_AND_SUB = r"(^\d{1,2}[a-zA-Z]*\.\D+)((?<!Clause )(?<!clause )\d{1,2}[a-zA-Z]*\.\d{0,2}\.*\d{0,2}\.*\d{0,2}\s*.*)"
SUB_SECTION_ID = r"^\d+[a-zA-Z]*\.\d+\.*\s*.*"
SUB_SUB_SECTION_ID = r"^\d+[a-zA-Z]*\.\d+\.\d+\.*\s*.*"
PERCENTAGES = [r"\d{1} %", r"\d{2} %", r"\d{1}%", r"\d{2}%", r"\d{1} percent", r"\d{2} percent", r"\d{1} per cent", r"\d{2} per cent"]
EMBEDDED_SECTION = r"\. \d{1,2}[a-zA-Z]*\.\d{0,2}\.*\d{0,2}\.*\d{0,2}"
LEADING_CLAUSE_NUMBER = r"^\d+\.*\d*\.*\d*"
TRAILING_DOT_ZERO = r"\.0$"

# -- zones of an agreement
CONTENTS_BEGIN = r"C\s*O\s*N\s*T\s*E\s*N\s*T\s*[S]*|TABLE OF CONTENT[S]*|I\s*N\s*D\s*E\s*X"
PARTIES_BEGIN = r"^THIS AGREEMENT is|is made on|^THIS AGREEMENT Between|is dated .* and made between|^PARTIES|^BETWEEN\s*:*|^AMONG:|^\"Borrower\"\)|^Date: Parties"
PARTIES_END = r"IT IS AGREED*:*|AGREED* as follows|AGREED* that|The parties agreed*(?!,)"
FIRST_SCHEDULE = r"^S\s*CHEDULE[S]*\s*[1|I]\b|^S\s*CHEDULE[S]*\s*[1|I]\D+|^THE FIRST SCHEDULE|^THE ORIGINAL LENDERS$|^THE PARTIES$|^PART A|^EXECUTION:-*\s*S\s*CHEDULE[S]*\s*[1|I]"
SECOND_SCHEDULE = r"S\s*CHEDULE[S]*\s*[2|II]\b|^S\s*CHEDULE[S]*\s*[2|II]\D+|^THE SECOND SCHEDULE"
CONTENTS_SCHEDULE_1 = r".*Schedule[s]*\s*1\.*:*\s([A-Za-z\s]*)\.+.*"
CONTENTS_SCHEDULE_1_BELOW = r".*1\.*:*\s([A-Za-z\s]*).*"
CONTENTS_SCHEDULE_1B = r"THE FIRST SCHEDULE*:*\s[HEREINBEFORE REFERRED TO ]*([A-Za-z\s]*)\.+.*"

# -- parties and definitions
IN_QUOTES = r'["|“]([^"“”]*)["|”]'
PARTY_TOGETHER = r".*\(.*[together|collectively],*.*the (.*);*.*\)"
PARTY_TOGETHER_2 = r".*\(.*[together|collectively],*.* (.*);*.*\)"
PARTY_BRACKET = r".*\((.*)\).*"
PARTY_AS = r".* as (?!of)\s*(.*)\s*(?!of)"
PARTY_AS_OF_BRACKET = r".* as (?!of)\s*(.*) of.*\("
PARTY_AS_BRACKET = r".* as (?!of)\s*(.*)\s*(?!of).*\("
DEFINITION_KEYS = ["means,", '" means', "means (?!of)", "means:", "has the meaning given to", "shall be construed as", "shall have the meaning given to", "is a reference to", "includes a reference to", "denote", "denotes", "has the same meaning", '".*"']
DEFINITION_KEYS_2 = ["include", "includes"]
BASEL_2 = r'^(["“”]Basel II["“”]|["“”]Basel 2["“”]|Basel II [^"“”]*|Basel 2[^"“”]*) means (.*)$'
DEFINES = '"(.*)" means.*'
DEFINITION_SECTION = "Definition|Interpretation"

# -- numbering of lists, in the order in which a number is tried
ONE_DIGIT = r"\b[1-9]\d{0,1}\b"
NUMBERING = [
    ("xyz", r"\b[xyz]\b"),
    ("XYZ", r"\b[XYZ]\b"),
    ("ROMAN", r"\b(?=[XVI])M*(X[L]|L?X{0,2})(I[XV]|V?I{0,3})\b"),
    ("roman", r"\b(?=[xvi])m*(x[l]|l?x{0,2})(i[xv]|v?i{0,3})\b"),
    ("A", r"\b[^\d\sIVXivxa-zXYZ\W_]{1}\b"),
    ("a", r"\b[^\d\sIVXivxA-Zxyz\W_]{1}\b"),
    ("AA", r"\b(AA|BB|CC|DD|EE|FF|GG|HH|JJ|KK|LL|MM|NN|OO|PP|QQ|RR|SS|TT|UU|VV|WW|XX|YY|ZZ)\b"),
    ("aa", r"\b(aa|bb|cc|dd|ee|ff|gg|hh|jj|kk|ll|mm|nn|oo|pp|qq|rr|ss|tt|uu|vv|ww|xx|yy|zz)\b"),
    ("1.1.1", rf"{ONE_DIGIT}\.{ONE_DIGIT}\.{ONE_DIGIT}"),
    ("1.1", rf"{ONE_DIGIT}\.{ONE_DIGIT}"),
    ("1", ONE_DIGIT),
]
#: Fixed values, as patterns: a number right after one of these refers to another place, it doesn't open an item.
BEFORE_A_REFERENCE = [
    "<", ">", r"\&", r"\(\d{1}\) to ", r"\(\d{2}\) to ", r"\(\w{1}\) to ", r"\(\w{2}\) to ", "added", "Agreement", "agreement", "aircraft", "Aircraft", "Article", "article", "Articles", "articles", "Basel", "BORROWER",
    "clause", "Clause", r"clause\(s\)", "clauses", "Clauses", "Column", "column", "Columns", "columns", "Company", "company", "Counsel", "counsel", "CRD", "Facility", "facility", "Facilities", "facilities", "General", "general",
    "greater than", "Guarantor", "guarantor", "items", "Items", "item", "Item", "in the case of", "In the case of", "KPI", "less than", "limbs", r"Or\.", "ordinance", "Ordinance", "para", r"para\.", r"Para\.", "Paragraph", "paragraph",
    r"Paragraph\(s\)", r"paragraph\(s\)", "Paragraphs", "paragraphs", "Plan", "plan", "Premium", "premium", "Property", "property", "Proviso", "proviso", "referred to", "Sect", r"Sect\.", "Section", "section", "Sections", "sections",
    "Shares", "shares", "Ship", "ship", "sub-paragraph", "Sub-paragraph", "sub-paragraphs", "Sub-paragraphs", "Tranche", "tranche", "Unit", "unit", "Vessel", "vessel", "°",
]
#: The same before a number in brackets, and before one with a full stop.
BEFORE_BRACKETS = [r"\(\w[\)|\.] and ", r"\w[\)|\.] and ", "within"]
BEFORE_A_DOT = [r"\d", r"[A-Z]\.", "at least", "at most", "exceed"]
#: And after it: what shows a number in brackets, or one with a full stop, to be part of a sentence.
AFTER_BRACKETS = [r" and \([a-zA-Z]\)", r",\([a-zA-Z]\)", r", \([a-zA-Z]\)", r" and \([a-zA-Z]{2}\)", r",\([a-zA-Z]{2}\)", r", \([a-zA-Z]{2}\)", r" and \([a-zA-Z]{3}\)", r",\([a-zA-Z]{3}\)", r", \([a-zA-Z]{3}\)"]
AFTER_A_DOT = [
    " above", "Sc", r"Sc\.", r"[a-zA-Z]\.", r"\d{1} \%", r"\d{1}\%", r"\d{1} \(", r"\d{1} per cent", r"\d{1} percent", r"\d{1} Years", r"\d{1} years", r"\d{1} yrs", r"\d{1}\([a-zA-Z]\)", r"\d{1}x",
    r"\d{2} \%", r"\d{2}\%", r"\d{2} \(", r"\d{2} per cent", r"\d{2} percent", r"\d{2} Years", r"\d{2} years", r"\d{2} yrs", "x", r"a\.",
]
PREPOSITIONS = [" above ", " below ", " above,", " below,", r" above\.", r" below\.", " from ", " than ", r" and\\or "]
#: Punctuation that may follow a number which opens an item.
MAY_FOLLOW = ["(", "[", '"', "$", ":"]

# -- summary documents
PREPOSITION_HEADINGS = [
    "about", "above", "across", "after", "along", "among", "at", "before", "below", "between", "by", "dated", "down", "during", "for", "from", "in", "inside", "into", "of",
    "on", "onto", "outside", "over", "since", "through", "to", "towards", "under", "until", "up", "with", "Name", "Signature", "Accepted by",
]
KEY_AND_VALUE = r".*(?<!\])(?<!means)(?<!means )(?<!Part \w)(?<!Part \d)\:"
NOT_A_KEY = r"^•*\s*\bFor\b|^•*\s*Tranche|^Note|^\[Note|^•*\s*WHT.*Lender"

# -- matching: (section, text, definition) and (section, text, schedule); an empty pattern matches all
DEFINITION_RULES = [
    ("^interest rate$", "HIBOR", "^HIBOR$|^margin$"),
    ("^interest rate$|Margin", "", "^margin$"),
    ("Margin", "", "^margin$"),
    ("", "material adverse change", "^material adverse change"),
    ("", "break cost", "^break cost"),
    ("", "break-funding cost", "^break cost"),
    ("^facilit", "up to", "total commitment"),
    ("first repayment date", "", "grace period"),
    ("Availability Period", "Final Maturity Date", "Final Maturity Date"),
    ("^facilities", "Revolving Credit Facility", "Initial RCF"),
    ("", "Permitted Transactions", "Permitted Transactions"),
    ("", "Consolidated Interest Expense", "Consolidated Interest Expense"),
    ("Insurances", "agreed value", "Agreed Value"),
    ("Interest Coverage Ratio", "Calculation Period", "Calculation Period"),
    ("HK Account Bank", "HK Account Bank", "Account Bank"),
    ("currency", "USD|HKD", "base currency"),
    ("Business Days", "day", "Business Days"),
    ("Material Subsidiaries", "", "Material Subsidiaries"),
    ("Guarantor", "Material Subsidiaries", "Material Subsidiary"),
    ("Drawdown", "prior written notice to", "Specified Time"),
    ("average life", "average life of", "^Termination Date"),
    ("facility amount", "tranche A|B", "^Total Facilty A|B Commitments$"),
    ("Tax Gross Up", "taxes", "^Taxes$"),
    ("Mandatory Prepayment", "LTV Ratio", "LTV Ratio Trigger Event"),
    ("Interest Rate", "Term SOFR", "^Reference Rate$"),
    ("", "Second Party Opinion", "^Second Party Opinion$"),
    ("^Security$", "second ranking security", "^Second Ranking Mortgage"),
    ("Extension Option", "Extended Participation", "Extended Final Maturity Date"),
    ("^project$", "Property development", "Development"),
    ("^Finance Parties", "", "^Finance Parties$"),
    ("^security$", "borrower", "^Initial Assignor"),
]
SCHEDULE_RULES = [
    ("^security", "", "^security document"),
    ("^conditions precedent", "", "(conditions precedent)|(Documents and evidence)|(Global Transfer Certificate)|(CONDITIONS SUBSEQUENT)"),
    ("Green Loan Provisions", "", "GREEN LOAN PRINCIPLES MEMORANDUM"),
]
TERM_SECTIONS = "(Documentation)|(Events of Default)|(Representations)|(Representations, Warranties and Undertakings)"
CLAUSE_TYPES = ["definitionClause", "partiesClause", "clause", "schedule"]
SENTINELS = ["nan", "None", ""]
