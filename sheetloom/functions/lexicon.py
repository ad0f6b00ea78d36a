"""Word lists and constants that fix results."""

from __future__ import annotations

# Header words of the sheet detector, in the order in which they are tried.
DETECTOR = {
    "doc_code": ["spec code", "code", "ref", "reference", "item code", "product code", "sku", "id"],
    "image": ["image", "photo", "indicative image", "picture", "item image", "img", "thumbnail"],
    "item_location": ["location", "description", "item & location", "item and location", "area", "room", "space"],
    "product_name": ["product name", "item name"],
    "specs": ["specification", "specifications", "specs", "notes/comments", "details", "spec"],
    "manufacturer": ["manufacturer", "supplier", "brand", "vendor", "maker", "manufacturer / supplier", "manufacturer/supplier", "make", "company"],
    "notes": ["notes", "comments", "remarks", "note", "comment"],
    "qty": ["qty", "quantity", "count", "units", "no.", "number"],
    "cost": ["cost", "rrp", "price", "indicative cost", "cost per unit", "total cost", "$", "unit price", "unit cost", "amount", "value"],
}
SUPPORTING = ["item_location", "specs", "manufacturer", "cost", "qty", "notes", "image"]
REQUIRED = ["doc_code", "product_name"]

# Header words of the column mapper, in order.
MAPPER = {
    "doc_code": ["spec code", "code", "ref", "reference", "item code", "product code", "sku", "id", "item ref", "product ref", "item no", "item number", "product no", "product number"],
    "product_name": ["product name", "item name", "product", "name", "item"],
    "image": ["image", "photo", "indicative image", "picture", "item image", "img", "thumbnail", "product image", "finish image", "feature image"],
    "item_location": ["location", "description", "item & location", "item and location", "area", "room", "space", "item/location", "item description", "product description"],
    "specs": ["specification", "specifications", "specs", "notes/comments", "details", "spec", "product details", "product specs", "technical specs", "technical specifications"],
    "manufacturer": [
        "manufacturer", "supplier", "brand", "vendor", "maker", "manufacturer / supplier", "manufacturer/supplier", "make", "company", "manufacturer & supplier", "manufacturer and supplier", "supplier/manufacturer",
    ],
    "notes": ["notes", "comments", "remarks", "note", "comment", "additional notes", "additional comments", "notes (supplier"],
    "qty": ["qty", "quantity", "count", "units", "no.", "number", "amount", "pcs", "pieces", "unit qty", "unit quantity"],
    "cost": ["cost", "rrp", "price", "indicative cost", "cost per unit", "cost per unit $", "$", "unit price", "unit cost", "value", "rate", "unit rate", "each", "per unit"],
    "total_cost": ["total cost", "total cost $", "total price", "total value", "extended cost", "extended price", "line total", "subtotal", "sub total"],
    "finish": ["finish", "surface", "surface finish", "coating", "treatment"],
    "material": ["material", "composition", "species", "substrate", "base material"],
    "colour": ["colour", "color", "col", "shade", "tint"],
    "width": ["width", "w", "wide"],
    "length": ["length", "l", "len", "long", "depth", "d"],
    "height": ["height", "h", "ht", "thickness", "thk"],
    "size": ["size", "dimensions", "dims", "dim", "measurements"],
    "lead_time": ["lead time", "leadtime", "delivery", "delivery time", "eta", "availability"],
    "client_discount": ["customer discount", "client discount", "discount", "disc", "disc %", "discount %"],
    "client_signoff": ["client initials", "client sign off", "client signoff", "sign off", "signoff", "approval", "approved", "initials"],
    "trade_price": ["trade", "trade $", "trade price", "trade cost", "wholesale", "wholesale price"],
}
CANONICALS = list(MAPPER)
FUZZY_THRESHOLD = 0.75
ROOM_HEADERS = ["room", "location", "item & location", "item and location", "item/location"]
USABLE = ["item_location", "specs", "manufacturer", "notes", "qty", "cost", "product_name"]

# Other spellings of the keys of KEY: VALUE text, and the keys they stand for.
KEY_ALIASES = {
    "COLOR": "COLOUR",
    "COIR COLOUR": "COLOUR",
    "COIR COLOR": "COLOUR",
    "SURFACE": "FINISH",
    "SURFACE FINISH": "FINISH",
    "COMPOSITION": "MATERIAL",
    "SPECIES": "MATERIAL",
    "W": "WIDTH",
    "WIDE": "WIDTH",
    "L": "LENGTH",
    "LEN": "LENGTH",
    "LONG": "LENGTH",
    "D": "DEPTH",
    "H": "HEIGHT",
    "HT": "HEIGHT",
    "THK": "THICKNESS",
    "DIMENSIONS": "SIZE",
    "DIMS": "SIZE",
    "DIM": "SIZE",
    "SHEET SIZE": "SIZE",
    "SHEET SIZE MAX": "SIZE",
    "MAKE": "MAKER",
    "VENDOR": "SUPPLIER",
    "COMPANY": "SUPPLIER",
    "REF": "CODE",
    "REFERENCE": "CODE",
    "PRODUCT CODE": "CODE",
    "ITEM CODE": "CODE",
    "SKU": "CODE",
    "LEAD TIME": "LEAD_TIME",
    "LEADTIME": "LEAD_TIME",
    "NOTE": "NOTES",
    "COMMENTS": "NOTES",
    "COMMENT": "NOTES",
    "CARPET THICKNESS": "CARPET_THICKNESS",
    "PILE HEIGHT": "PILE_HEIGHT",
    "PILE WEIGHT": "PILE_WEIGHT",
    "QUANTITY": "QTY",
}

# Names of units of length, and millimetres in one.
UNITS = {
    "mm": 1.0,
    "millimeter": 1.0,
    "millimeters": 1.0,
    "millimetre": 1.0,
    "millimetres": 1.0,
    "cm": 10.0,
    "centimeter": 10.0,
    "centimeters": 10.0,
    "centimetre": 10.0,
    "centimetres": 10.0,
    "m": 1000.0,
    "meter": 1000.0,
    "meters": 1000.0,
    "metre": 1000.0,
    "metres": 1000.0,
    "in": 25.4,
    "inch": 25.4,
    "inches": 25.4,
    '"': 25.4,
}

# Keys of detail rows; rows to skip; words of a repeated header row; labels; titles.
DETAIL_KEYS = [
    "maker:",
    "name:",
    "finish:",
    "size:",
    "lead time:",
    "notes:",
    "leadtime:",
    "material:",
    "colour:",
    "color:",
    "brand:",
    "supplier:",
    "manufacturer:",
    "dimensions:",
    "dim:",
    "width:",
    "height:",
    "length:",
    "depth:",
    "item:",
]
SKIP = r"^(delivery|shipping|freight|totals?|sub\s*total|grand\s*total|gst|tax)$"
ECHO_CODE = ["spec code", "doc code", "drawing code", "code", "ref", "ref no", "reference", "id", "sku", "item code", "product code"]
ECHO = {
    "item_location": ["item & location", "item and location", "area", "room", "location", "description"],
    "specs": ["specification", "specifications", "specs", "notes/comments", "details", "spec"],
    "manufacturer": ["manufacturer", "supplier", "brand", "vendor", "maker", "manufacturer / supplier"],
    "notes": ["notes", "comments", "remarks"],
    "qty": ["qty", "quantity", "units", "no.", "no"],
    "cost": ["cost", "rrp", "price", "indicative cost", "cost per unit", "unit price", "unit cost", "$"],
}
LABELS = [
    "job no.", "job no", "job name.", "job name", "revision date", "revision no.", "revision no", "revision", "date", "client name:", "client name", "project address:", "project address", "version:", "version", "issue date:", "issue date", "project:", "project", "rev", "rev.", "notes", "legend",
]
TITLE_WORDS = ["schedule", "project", "interior", "finish", "ff&e", "ffe"]
DISCLAIMERS = [
    "refer to drawings",
    "refer to plans",
    "for full detail",
    "images and costs",
    "verify on site",
    "prior to order",
    "indicative only",
    "all dimensions",
]

#: Texts that say that there is no price; words for prices, and how many characters may stand behind one before the number.
NO_PRICE = ["tbc", "tba", "poa", "n/a", "na", "nil", "-"]
PRICE_WORDS, PRICE_NEAR = ["rrp", "price", "cost", r"unit\s*cost", "rate"], 20

#: What may stand in brackets at a schedule name's end without being part of it; kinds of image files.
NAME_TAIL, NAME_TAIL_OF = "tracker", ["ff&e", "ffe"]
IMAGE_KINDS = ["jpg", "jpeg", "png", "gif", "webp"]
