"""Named colours: the CSS names, of public standing, as (name, 0xRRGGBB)."""

NAMED = {
    "black": 0x000000, "silver": 0xC0C0C0, "gray": 0x808080, "white": 0xFFFFFF, "maroon": 0x800000, "red": 0xFF0000, "purple": 0x800080, "fuchsia": 0xFF00FF, "green": 0x008000, "lime": 0x00FF00,
    "olive": 0x808000, "yellow": 0xFFFF00, "navy": 0x000080, "blue": 0x0000FF, "teal": 0x008080, "aqua": 0x00FFFF, "orange": 0xFFA500, "brown": 0xA52A2A, "chocolate": 0xD2691E, "tan": 0xD2B48C,
    "beige": 0xF5F5DC, "ivory": 0xFFFFF0, "khaki": 0xF0E68C, "gold": 0xFFD700, "goldenrod": 0xDAA520, "coral": 0xFF7F50, "salmon": 0xFA8072, "tomato": 0xFF6347, "crimson": 0xDC143C, "pink": 0xFFC0CB,
    "orchid": 0xDA70D6, "plum": 0xDDA0DD, "violet": 0xEE82EE, "indigo": 0x4B0082, "lavender": 0xE6E6FA, "slateblue": 0x6A5ACD, "skyblue": 0x87CEEB, "steelblue": 0x4682B4, "turquoise": 0x40E0D0, "cyan": 0x00FFFF,
    "seagreen": 0x2E8B57, "darkgreen": 0x006400, "olivedrab": 0x6B8E23, "chartreuse": 0x7FFF00, "sienna": 0xA0522D, "peru": 0xCD853F, "wheat": 0xF5DEB3, "linen": 0xFAF0E6, "dimgray": 0x696969, "gainsboro": 0xDCDCDC,
    "darkred": 0x8B0000, "firebrick": 0xB22222, "darkorange": 0xFF8C00, "sandybrown": 0xF4A460, "rosybrown": 0xBC8F8F, "saddlebrown": 0x8B4513, "darkkhaki": 0xBDB76B, "midnightblue": 0x191970, "royalblue": 0x4169E1, "cadetblue": 0x5F9EA0,
}
