"""Words and marks by which financial text is recognised."""

FINANCIAL = ["выручка", "прибыль", "актив", "капитал", "руб", "тыс", "млн", "млрд", "баланс", "обязательств", "ликвидност", "дебитор", "кредитор", "запас", "revenue", "profit", "asset", "equity", "liabilit", "cash", "риск", "убыт", "задолж", "снижен", "рост", "падени", "debt", "loss", "risk", "decline", "growth"]
TOTALS = ["итого", "итого по разделу", "total", "subtotal", "balance", "assets", "liabilities", "equity"]
UNITS = ["тыс", "тыс.", "млн", "млн.", "млрд", "млрд.", "руб", "руб.", "thousand", "million", "billion"]
MILLIONS = ["в миллионах рублей", "млн руб", "млн. руб", "в млн.", "тыс. млн", "in millions", "millions of rubles"]
THOUSANDS = ["в тысячах рублей", "тыс. руб", "тыс.руб", "в тыс.", "в тысячах", "in thousands", "thousands of rubles"]
BILLIONS = ["в миллиардах рублей", "млрд руб", "млрд. руб", "в млрд.", "in billions"]
TITLES = [
    "consolidated balance sheets", "consolidated statements of operations", "consolidated statements of income", "consolidated statements of stockholders",
    "consolidated statements of cash flows", "statement of financial position", "balance sheet", "отчет о финансовом положении", "бухгалтерский баланс",
    "отчет о прибылях и убытках", "консолидированный отчет о прибыли и убытке", "отчет о движении денежных средств", "консолидированный отчет об изменениях в капитале",
]
#: English label of a row, metric; an earlier label decides where several fit.
LABELS = {
    "revenue": "revenue", "total revenue": "revenue", "turnover": "revenue", "net sales": "revenue", "net profit": "net_profit", "net income": "net_profit",
    "profit for the year": "net_profit", "profit for the period": "net_profit", "profit attributable to owners": "net_profit",
    "profit attributable to shareholders": "net_profit", "operating profit": "ebit", "ebitda": "ebitda", "total assets": "total_assets",
    "non-current assets": "total_assets", "current assets": "current_assets", "property, plant and equipment": "total_assets", "intangible assets": "total_assets",
    "total equity": "equity", "equity attributable to owners": "equity", "share capital": "equity", "retained earnings": "equity",
    "total shareholders' equity": "equity", "total liabilities": "liabilities", "total equity and liabilities": "liabilities",
    "current liabilities": "short_term_liabilities", "non-current liabilities": "long_term_liabilities", "trade payables": "liabilities",
    "short-term borrowings": "short_term_borrowings", "current borrowings": "short_term_borrowings", "long-term borrowings": "long_term_borrowings",
    "non-current borrowings": "long_term_borrowings", "short-term lease liabilities": "short_term_lease_liabilities",
    "current lease liabilities": "short_term_lease_liabilities", "long-term lease liabilities": "long_term_lease_liabilities",
    "non-current lease liabilities": "long_term_lease_liabilities", "cash and cash equivalents": "cash_and_equivalents",
    "trade receivables": "accounts_receivable", "inventories": "inventory", "stocks": "inventory", "finance costs": "interest_expense",
    "interest expense": "interest_expense",
}
#: Label of a row in the national language, in its own letters and as a wrong code page shows them.
NATIONAL_LABELS = {
    "выручка": "revenue", "чистая прибыль": "net_profit", "прибыль за год": "net_profit", "прибыль за период": "net_profit", "итого активов": "total_assets",
    "итого активы": "total_assets", "итого капитала": "equity", "итого капитал": "equity", "собственный капитал": "equity", "денежные средства": "cash_and_equivalents",
    "запасы": "inventory", "дебиторская задолженность": "accounts_receivable", "краткосрочные обязательства": "short_term_liabilities",
    "оборотные активы": "current_assets", "операционная прибыль": "ebit", "финансовые расходы": "interest_expense", "себестоимость": "cost_of_goods_sold",
    "т√Ёєўър": "revenue", "шс√ы№ чр уюф": "net_profit", "шёЄр  яЁшс√ы№": "net_profit", "Єюую ръЄшт√": "total_assets", "шЄюую ъряшЄры": "equity",
    "Єюую ъряшЄры": "equity", "хэхцэ√х ёЁхфёЄтр": "cash_and_equivalents", "рярё√": "inventory", "хсшЄюЁёър  чрфюыцхээюёЄ№": "accounts_receivable",
    "ЁрЄъюёЁюўэ√х юс чрЄхы№ёЄтр": "short_term_liabilities", "сюЁюЄэ√х ръЄшт√": "current_assets", "юяхЁрЎшюээр  яЁшс√ы№": "ebit",
    "Їшэрэёют√х Ёрёїюф√": "interest_expense", "хсхёЄюшьюёЄ№": "cost_of_goods_sold",
}
#: Label, the metric that it approximates, and why.
APPROXIMATE_LABELS = {"gross profit": ("ebitda", "gross_profit_to_ebitda_approximation")}
#: By metric, the keywords of its rows and lines.
KEYWORDS = {
    "revenue": ["выручка от реализации", "выручка", "доходы от реализации", "доход от продаж", "совокупный доход", "выручка от продаж", "revenues", "revenue", "total revenues", "total revenue", "sales revenue", "net sales", "turnover", "консолидированная выручка", "consolidated revenue"],
    "net_profit": [
        "чистая прибыль (убыток)", "чистая прибыль", "чистый убыток", "прибыль за период", "прибыль за год", "прибыль после налогообложения", "чистая прибыль за год", "чистая прибыль за период", "совокупный финансовый результат",
        "net profit", "net income", "net loss", "profit for the year", "profit for the period", "profit (loss)", "profit for the year attributable to", "net profit attributable to", "чистая прибыль, относящаяся к акционерам", "net profit attributable to owners",
    ],
    "total_assets": ["итого активов", "итого активы", "активы всего", "активов всего", "баланс", "внеоборотные и оборотные активы", "total assets", "assets total", "total non-current and current assets", "консолидированные активы", "consolidated total assets"],
    "equity": [
        "итого по разделу iii", "итого капитала", "капитал и резервы", "собственный капитал", "капитал", "итого капитал", "капитала всего", "total stockholders' equity", "stockholders' equity", "total shareholders' equity", "shareholders' equity",
        "total equity", "equity total", "equity attributable to owners", "капитал, относящийся к акционерам", "капитал и резервы, относящиеся к акционерам", "total equity attributable to",
    ],
    "liabilities": ["итого обязательств", "обязательства всего", "долгосрочные и краткосрочные обязательства", "total liabilities", "liabilities total", "total non-current and current liabilities", "консолидированные обязательства"],
    "current_assets": ["итого оборотных активов", "итого оборотные активы", "оборотные активы всего", "итого по разделу ii", "оборотные активы", "total current assets", "current assets total", "консолидированные оборотные активы"],
    "short_term_liabilities": [
        "итого краткосрочных обязательств", "итого краткосрочные обязательства", "краткосрочные обязательства всего", "итого по разделу v", "итого по разделу у", "краткосрочные обязательства",
        "total current liabilities", "current liabilities total", "short-term liabilities", "консолидированные краткосрочные обязательства",
    ],
    "accounts_receivable": [
        "дебиторская задолженность", "торговая дебиторская задолженность", "краткосрочная дебиторская задолженность", "accounts receivable", "trade receivables", "trade and other receivables", "current receivables",
        "торговая и прочая дебиторская задолженность",
    ],
    "inventory": ["запасы", "товарно-материальные ценности", "запасы и затраты", "производственные запасы", "inventory", "merchandise", "stocks", "inventories"],
    "cash_and_equivalents": ["денежные средства", "наличные", "денежные средства и эквиваленты", "cash and equivalents", "cash and cash equivalents", "cash", "cash at bank and in hand"],
    "ebitda": ["ebitda", "ebit до амортизации", "показатель ebitda", "earnings before interest, taxes, depreciation and amortization"],
    "ebit": ["ebit", "операционная прибыль", "прибыль от операций", "прибыль от операционной деятельности", "operating profit", "profit from operations", "operating income"],
    "interest_expense": ["финансовые расходы", "процентные расходы", "процентные платежи", "расходы по процентам", "interest expense", "interest paid", "finance costs", "finance expenses", "interest and similar charges"],
    "cost_of_goods_sold": ["себестоимость продаж", "себестоимость", "коммерческие расходы", "cost of goods sold", "cogs", "cost of sales", "direct costs"],
    "average_inventory": ["средний запас", "средний остаток запасов", "average inventory", "average stocks"],
    "short_term_borrowings": ["краткосрочные кредиты и займы", "краткосрочные заемные средства", "short-term borrowings", "current borrowings"],
    "long_term_borrowings": ["долгосрочные кредиты и займы", "долгосрочные заемные средства", "long-term borrowings", "non-current borrowings"],
    "short_term_lease_liabilities": ["краткосрочные обязательства по аренде", "краткосрочная аренда", "short-term lease liabilities", "current lease liabilities"],
    "long_term_lease_liabilities": ["долгосрочные обязательства по аренде", "долгосрочная аренда", "long-term lease liabilities", "non-current lease liabilities"],
}
#: By metric, the line codes of the national form in a text, and words of which the line has to have one (None: none).
TEXT_CODES = {
    "revenue": (["2110"], ["выручка от реализации, без ндс", "выручка", "revenue"]),
    "net_profit": (["2400"], ["чистая прибыль", "чистая прибыль общества", "прибыль за период", "прибыль за год", "net profit", "net income"]),
    "total_assets": (["1600", "1700"], None),
    "current_assets": (["1200"], None),
    "inventory": (["1210"], ["запасы", "inventory"]),
    "accounts_receivable": (["1230"], ["дебиторская задолженность", "accounts receivable", "trade receivables"]),
    "long_term_liabilities": (["1400"], ["долгосрочные обязательства", "итого по разделу iv", "total non-current liabilities"]),
    "short_term_liabilities": (["1500"], ["краткосрочные обязательства", "итого краткосрочных обязательств", "итого краткосрочные обязательства", "total current liabilities"]),
    "cash_and_equivalents": (["1250"], ["денежные средства", "cash and cash equivalents"]),
}
#: The codes of the results in forms without tables.
RESULT_CODES = {
    "revenue": (["2110"], ["выручка от реализации, без ндс", "выручка", "revenue"], 110),
    "net_profit": (["2400"], ["чистая прибыль", "net profit", "net income", "profit for the period"], 120),
}
#: What a form without tables may give by keywords and patterns.
FORM_METRICS = ["revenue", "net_profit", "total_assets", "current_assets", "accounts_receivable", "inventory"]
#: Marks of the national forms, of balances, and of the section with the results.
FORM_MARKS = ["форма 071000", "бухгалтерский баланс", "отчет о финансовых результатах"]
BALANCE_FORM_MARKS = ["бухгалтерский баланс", "форма 0710001", "итого по разделу iii", "итого по разделу ш", "итого по разделу iv", "итого по разделу v", "итого по разделу у"]
RESULTS_START = ["отчет о финансовых результатах", "отчёт о финансовых результатах", "statement of income", "statement of profit"]
RESULTS_END = [
    "бухгалтерский баланс", "отчет об изменениях капитала", "отчёт об изменениях капитала", "отчет о движении денежных средств", "отчёт о движении денежных средств",
    "statement of changes in equity", "statement of cash flows", "руководитель",
]
COMPREHENSIVE = ["совокупный финансовый результат периода", "total comprehensive income"]
#: Totals of a form's sections, and lines near them that are none.
SECTION_TOTALS = {
    "short_term_liabilities": ["итого по разделу v", "итого по разделу у", "итого краткосрочных обязательств", "итого краткосрочные обязательства"],
    "long_term_liabilities": ["итого по разделу iv", "итого долгосрочных обязательств"],
    "equity": ["итого по разделу ш", "итого по разделу iii"],
}
NEAR_TOTALS_NOT = ["поясне", "форма 07", "руководитель", "подпись", "итого по разделу"]
#: By metric, the phrases of the last patterns: how many other characters than digits may follow until the number, or None for a
#: cell mark between.
BROAD = {
    "revenue": [("total revenues", None), ("revenues", None), ("выручка от реализации", None), ("выручка", 80), ("total revenues", 80), ("revenues", 80), ("turnover", 60), ("net sales", 60), ("consolidated revenue", 60)],
    "net_profit": [
        ("чистая прибыль", None), ("чистая прибыль", 60), ("прибыль после налогообложения", 80), ("net income", None), ("net income", 80), ("net loss", None), ("net loss", 80), ("profit for the year", 80),
        ("profit for the period", 80), ("profit attributable to", 80), ("net profit attributable", 80),
    ],
    "total_assets": [("total assets", None), ("итого активов", None), ("итого активов", 60), ("баланс", None), ("total assets", 80), ("non-current and current assets", 80), ("consolidated assets", 60)],
    "equity": [
        ("итого капитала", None), ("итого капитала", 60), ("собственный капитал", None), ("капитал и резервы", None), ("total stockholders' equity", None), ("total stockholders' equity", 80), ("stockholders' equity", 80),
        ("total shareholders' equity", 80), ("total equity", None), ("total equity", 80), ("equity attributable to", 80), ("shareholders' equity", 80),
    ],
    "current_assets": [("total current assets", None), ("total current assets", 80), ("итого оборотных активов", None), ("итого оборотных активов", 60), ("итого оборотные активы", 60)],
    "short_term_liabilities": [("total current liabilities", None), ("total current liabilities", 80), ("итого краткосрочных обязательств", None), ("итого краткосрочных обязательств", 80), ("итого краткосрочные обязательства", 80)],
    "cost_of_goods_sold": [("себестоимость продаж", None), ("себестоимость продаж", 80)],
}
#: Headings of table sections whose totals may stand without a label, their metric, what ends them, and longer headings that are not theirs.
SECTIONS = {
    "current_assets": (["оборотные активы", "current assets"], ["итого активы", "total assets", "капитал и обязательства", "equity and liabilities"], ["внеоборотн", "non-current"]),
    "short_term_liabilities": (["краткосрочные обязательства", "current liabilities"], ["итого обязательства", "total liabilities", "итого капитал и обязательства", "total equity and liabilities"], ["долгосрочн", "non-current"]),
}
WHOLE_BALANCE = (["итого активы", "total assets"], ["капитал и обязательства", "total equity and liabilities", "equity and liabilities"])
RESTATED = ["первоначально представлено", "эффект от пересчета", "как пересчитано"]
#: Four-digit line codes of the national form.
CODES = {
    "2110": "revenue", "2400": "net_profit", "1600": "total_assets", "1700": "total_assets", "1300": "equity", "1200": "current_assets", "1500": "short_term_liabilities",
    "1400": "long_term_liabilities", "1230": "accounts_receivable", "1210": "inventory", "1250": "cash_and_equivalents", "2120": "cost_of_goods_sold", "2200": "ebit",
}
#: How the test statements name their facts.
PRINTED = {
    "revenue": "Revenue", "net_profit": "Net profit", "cost_of_goods_sold": "Cost of goods sold", "interest_expense": "Interest expense", "total_assets": "Total assets",
    "equity": "Total equity", "liabilities": "Total liabilities", "current_assets": "Total current assets", "short_term_liabilities": "Short-term liabilities",
    "accounts_receivable": "Trade receivables", "cash_and_equivalents": "Cash and cash equivalents",
}
#: Marks of narrative on a line that names a metric.
NARRATIVE = [
    "consolidated statements of", "statement of stockholders", "statement of shareholders", "increase", "decrease", "decline", "growth", "represented more than",
    "customer accounted", "future", "may ", "could ", "price", "market value", "equity compensation", "risk", "table of contents",
]
#: Marks of the pages that hold a balance and the results, and of their rows.
BALANCE_MARKS = ["бухгалтерский баланс", "отчет о финансовом положении", "balance sheet"]
RESULT_MARKS = ["отчет о финансовых результатах", "отчет о прибыли и убытке", "statement of income", "statements of operations"]
ROW_MARKS = ["1600", "1200", "1250", "2110", "2400", "выручка", "чистая прибыль", "итого по разделу"]
#: Marks of liabilities: each line is a set of alternatives, of which every part (and of a part, one form) has to be there.
LIABILITY_MARKS = [
    [["1700"]], [["1400"], ["1500"]], [["итого по разделу iv"], ["итого по разделу v", "итого по разделу у"]], [["total liabilities"], ["current liabilities", "non-current liabilities"]],
]
HIDDEN_TEXT = "[DEMO: текст скрыт]"
#: Words of financial tables, of their strong rows, and of tables that are none.
TABLE_WORDS = ["выручка", "прибыль", "актив", "обязательств", "капитал", "revenue", "profit", "assets", "liabilities", "equity", "баланс", "отчёт", "финансов", "оборотн", "внеоборотн"]
STRONG_ROWS = ["выручка", "прибыль за год", "прибыль за период", "чистая прибыль", "итого активы", "итого обязательства", "денежные средства", "капитал", "revenue", "net income", "net profit", "total assets", "total liabilities", "current assets", "stockholders' equity"]
TABLE_NOISE = ["содержание", "аудиторское заключение", "основные принципы", "учетной политики", "table of contents", "independent auditor", "notes to"]
