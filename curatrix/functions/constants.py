"""Names, patterns, prompts and numbers that results depend on."""

SUPPLEMENT, FLAMMABLE = "БАД", "Легковоспламеняющиеся"
CATEGORIES = (SUPPLEMENT, FLAMMABLE)

#: Column names that stand for each role of a card.
ALIASES = {
    "id": ("id", "item_id", "product_id", "offer_id", "sku", "ozon_id"),
    "title": ("title", "name", "product_name", "item_name", "offer_name"),
    "description": ("description", "desc", "product_description", "annotation"),
    "brand": ("brand", "brand_name", "manufacturer", "vendor", "trademark"),
    "category": ("category", "category_name", "cat", "type_name"),
    "attributes": ("attributes", "attrs", "characteristics", "properties"),
    "images": ("images", "image", "image_url", "image_urls", "picture", "picture_url", "photo", "photos"),
    "label": ("label", "target", "class", "quality", "decision", "is_valid", "moderation_label"),
    "group": ("group", "group_id", "seller_id", "shop_id", "vendor_id"),
}
TEXT_FIELDS = ("title", "brand", "description", "category", "attributes")
NEGATIVE_CELLS = ("", "0", "false", "no", "нет", "nan", "none")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")

#: Rule families by category: a token is appended for each family that matches.
RULE_FAMILIES = {
    SUPPLEMENT: {
        "bad_direct": (r"\bбад\b", r"биологически\s+активн", r"dietary\s+supplement", r"не\s+является\s+лекарств", r"свидетельств.{0,20}государственн.{0,20}регистрац"),
        "sports_food": (r"спортивн.{0,12}питан", r"\bbcaa\b", r"\bпротеин", r"аминокислот", r"l[\s-]?карнитин", r"предтрен", r"гейнер"),
        "explicit_not_bad": (r"не\s+(?:является|относится).{0,20}\bбад\b",),
    },
    FLAMMABLE: {
        "ignition_source": (r"зажигал", r"\bспич", r"огнив", r"источник.{0,15}(?:огня|пламени|воспламен)"),
        "fuel_content": (r"жидкост.{0,15}(?:розжиг|зажигал)", r"газ.{0,15}(?:баллон|зажигал|горюч)", r"\bбутан\b", r"\bпропан\b", r"\bкеросин\b", r"\bбензин\b", r"легковоспламен"),
        "without_content": (r"без\s+(?:газа|топлива|жидкости|спичек|угля)", r"не\s+входит\s+в\s+комплект", r"поставляется\s+без"),
        "construction_only": (r"\bмангал", r"\bгрил", r"газов.{0,10}плит", r"горелк.{0,20}(?:встроен|пьезо)"),
    },
}

#: Ordered title rules (name, pattern on the normalised title, label); the last match wins.
TITLE_RULES = (
    ("standalone_coal_or_fuel_briquette", r"\b(?:уголь\s+(?:древесн\w*|каменн\w*)|брикетированн\w*\s+топлив\w*)\b", 1),
    ("disposable_grill_with_coal", r"(?:мангал\w*.*одноразов\w*.*угл|одноразов\w*.*мангал\w*.*угл)", 1),
    ("gas_for_portable_stove_or_burner", r"\bгаз\w*\s+(?:для|к)\s+портативн\w*\s+(?:плит\w*|горел\w*)\b", 1),
    ("smoke_bomb", r"\b(?:дым\w*\s+шашк\w*|шашк\w*\s+дым\w*)\b", 1),
    ("barbecue_fuel_briquette", r"\bбрикет\w*\s+для\s+грил\w*\b", 1),
    ("dry_fuel_with_ignition_source", r"\bсух\w*\s+горюч\w*.*(?:\bс\s+поджиг\w*|\bспичк\w*)", 1),
)
SHIPPED_RULES = tuple(name for name, _, _ in TITLE_RULES[:5])

#: Evidence families (pattern, description) by category.
EVIDENCE = {
    SUPPLEMENT: (
        (r"\bбад\b|биологически\s+активн|dietary\s+supplement", "прямая маркировка товара как БАД"),
        (r"спортивн.{0,12}питан|\bbcaa\b|протеин|аминокислот|l[\s-]?карнитин", "признаки спортивного питания"),
        (r"не\s+(?:является|относится).{0,20}\bбад\b", "явное указание, что товар не является БАД"),
    ),
    FLAMMABLE: (
        (r"зажигал|\bспич|огнив|фейервер|пиротех|дымов.{0,12}шаш|цветн.{0,10}дым", "самостоятельный источник воспламенения или пиротехническое изделие"),
        (r"газ.{0,15}(?:баллон|зажигал|горюч)|\bбутан\b|\bпропан\b|\bкеросин\b|\bбензин\b|жидкост.{0,15}розжиг", "горючее вещество или газ"),
        (r"без\s+(?:газа|топлива|жидкости|спичек|угля)|не\s+входит\s+в\s+комплект|поставляется\s+без", "поставка без горючего содержимого"),
        (r"\bмангал|\bгрил|газов.{0,10}плит", "только конструкция для использования с огнём"),
    ),
}

#: Features of recognised text on pictures.
OCR_FEATURES = {
    "ocr_pyro": r"пиротехник|хлопушк|петард|салют|бенгальск|дымов|шашк|фейерверк|18\+|громкий",
    "ocr_coal": r"уголь|брикет|charcoal|briquette",
    "ocr_gas_fuel": r"газ|баллон|топлив|fuel|бензин",
    "ocr_matches": r"спичк|зажигалк|розжиг|горелк|burner|lighter|сухое горюч",
    "ocr_bad_marking": r"бад|биологически активн|dietary supplement",
    "ocr_warning": r"огнеопасн|легковоспламен|flammable|горюч|воспламен|18\+|класс опасност",
    "ocr_set_contents": r"в комплект|в набор|содержит|включает|внутри",
    "ocr_confetti": r"конфетти|серпантин|confetti",
}

#: Ordered error families (name, words); the first that occurs counts.
ERROR_FAMILIES = (
    ("party_cracker", ("хлопушк",)),
    ("candle_sparkler", ("свеч", "бенгальск", "фонтан")),
    ("burner_gas", ("горелк", "газ", "баллон")),
    ("gift_set", ("набор", "подарочн", "выжива")),
    ("ignition_fuel", ("розжиг", "горюч", "топлив", "сухое")),
)

TASK_CONTEXT = {
    SUPPLEMENT: "Определи, соответствует ли товар категории БАД. Положительный класс требует прямой маркировки БАД, биологически активная добавка или dietary supplement. Спортивное питание и товары без такой маркировки относятся к отрицательному классу.",
    FLAMMABLE: "Определи, является ли сам товар или содержимое комплекта легковоспламеняющимся: источник открытого огня, горючее вещество или газ — положительный класс. Пустая конструкция, встроенный источник и горючий компонент изделия — отрицательный класс.",
}
RULE_PROMPTS = {
    SUPPLEMENT: "Верни 1 только если в тексте или на упаковке есть прямая маркировка БАД, биологически активная добавка или dietary supplement. Спортивное питание, явное указание что товар не БАД и отсутствие прямой маркировки означают 0.",
    FLAMMABLE: "Верни 1, если сам товар является источником открытого огня, содержит горючее вещество или газ либо такой предмет входит в комплект. Верни 0 для пустой конструкции, встроенного источника, горючего компонента изделия или отсутствующего в комплекте содержимого.",
}
MODERATOR = "Ты строгий модератор маркетплейса. Верни только 0 или 1."

#: Fusion with the nearest references, and the linear head.
KNN = {"knn_threshold": -0.001455795718356967, "base_threshold": 0.3310261532664299, "margin_scale": 0.01, "knn_alpha": 0.3, "blend_threshold": 0.2599999560899826}
KNN_SEEDS = (41, 43, 47, 51, 59)
HEAD = {"C": 0.03, "alpha_head": 0.25, "blend_threshold": 0.26}
RESULT_PATTERN = r"(?s)\A<комментарий>(.{50,300})<вердикт>(бан|не бан)\z"

#: Texts that stand for what the flammable rule bans, and for what it lets pass.
PROTOTYPES_POSITIVE = (
    "Matches sold as a product; a standalone source of open flame.",
    "A refillable cigarette or utility lighter that creates an open flame.",
    "A gas canister containing butane or propane fuel.",
    "A refill bottle containing lighter fluid, kerosene, gasoline, or another flammable liquid.",
    "A camping kit that explicitly includes a filled fuel or gas cylinder.",
    "A torch or burner sold together with a gas canister containing fuel.",
    "Dry fuel tablets, solid alcohol, or fire-starting briquettes sold for ignition.",
    "Charcoal, coal, wood briquettes, or combustible fuel sold for a grill or stove.",
    "Fire starter rolls, paraffin cubes, kindling, or ignition sticks that are consumed by fire.",
    "Fireworks, firecrackers, pyrotechnics, a flare, or a colored smoke bomb.",
    "A candle or wax torch whose main purpose is maintaining an open flame.",
    "A party kit that explicitly includes candles, matches, a lighter, or another flammable item.",
    "A self-heating ration or portable heater kit containing fuel tablets and matches.",
    "A survival kit that explicitly lists matches, dry fuel, or a fire starter among included items.",
    "A combustible gas refill for portable stoves or lighters, with contents present.",
    "Спички или зажигалка как самостоятельный товар и источник открытого огня.",
    "Газовый баллон с бутаном или пропаном; горючее содержимое присутствует.",
    "Жидкость для розжига, керосин, бензин или топливо для зажигалок.",
    "Сухое горючее, парафиновые кубики, растопка или брикеты для разведения огня.",
    "Уголь, дрова или древесные топливные брикеты для мангала и печи.",
    "Газовая горелка в комплекте с наполненным топливным баллоном.",
    "Пиротехника, петарда, фейерверк, сигнальный огонь или цветной дым.",
    "Туристический набор, в который явно входят спички, сухое горючее или газ.",
)
PROTOTYPES_NEGATIVE = (
    "An empty barbecue grill, brazier, fire pit, or metal construction sold without fuel.",
    "A gas stove or cooking appliance sold without a gas cylinder or fuel.",
    "An empty torch or burner attachment that contains no gas or combustible substance.",
    "An appliance with a built-in piezo ignition source; the source is only a component.",
    "A holder, case, cover, stand, adapter, nozzle, or accessory for a lighter or gas cylinder.",
    "A product compatible with gas or fuel, but the gas cylinder or fuel is not included.",
    "A charcoal filter in which activated carbon is only a component of the finished product.",
    "Drawing charcoal, a graphite pencil, pigment, or art material not sold as fuel.",
    "A decorative electric candle or LED light with no open flame or combustible contents.",
    "A fire extinguisher, fire blanket, alarm, or other fire-safety product.",
    "A party decoration or confetti popper with no pyrotechnic or combustible charge.",
    "An empty reusable container intended to be filled later with fuel.",
    "A tool or construction designed to work near fire whose sold contents are not flammable.",
    "A kit where matches, fuel, gas, charcoal, or candles are explicitly not included.",
    "A finished item containing a small combustible material only as a non-sold component.",
    "Пустой мангал, гриль, печь или костровая чаша без угля, газа и топлива.",
    "Газовая плита без баллона; устройство совместимо с газом, но газ не входит в комплект.",
    "Пустая горелка-насадка без горючего содержимого и без баллона в комплекте.",
    "Встроенный пьезоподжиг является компонентом устройства, а не отдельным товаром.",
    "Чехол, держатель, переходник, насадка или аксессуар без топлива и источника огня.",
    "Активированный уголь внутри фильтра или уголь для рисования, не являющийся топливом.",
    "Электрическая декоративная свеча или светильник без открытого огня.",
    "Топливо, газ, спички или уголь явно не входят в комплект товара.",
)
