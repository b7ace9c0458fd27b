"""License texts that op9 looks for: (license, lines of the template, mandatory phrases).

Whole notices and bodies beside the one-line mentions that texts carry.  Words are compared in lower case, without signs.
"""

Template = tuple[str, tuple[str, ...], tuple[str, ...]]

_WARRANTY = (
    "is provided \"AS IS\", WITHOUT WARRANTY", "OF ANY KIND, EXPRESS OR IMPLIED,", "INCLUDING BUT NOT LIMITED TO", "THE WARRANTIES OF MERCHANTABILITY,",
    "FITNESS FOR A PARTICULAR PURPOSE", "AND NONINFRINGEMENT.",
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "\"AS IS\" AND ANY EXPRESS", "OR IMPLIED WARRANTIES, INCLUDING,", "BUT NOT LIMITED TO,",
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY", "AND FITNESS FOR A PARTICULAR PURPOSE", "ARE DISCLAIMED.", "IN NO EVENT SHALL", "THE COPYRIGHT HOLDER OR CONTRIBUTORS", "BE LIABLE FOR ANY DIRECT,",
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,", "OR CONSEQUENTIAL DAMAGES", "(INCLUDING, BUT NOT LIMITED TO,", "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;", "LOSS OF USE, DATA, OR PROFITS;",
    "OR BUSINESS INTERRUPTION)", "HOWEVER CAUSED AND ON ANY THEORY", "OF LIABILITY, WHETHER IN CONTRACT,", "STRICT LIABILITY, OR TORT", "(INCLUDING NEGLIGENCE OR OTHERWISE)",
    "ARISING IN ANY WAY", "OUT OF THE USE OF THIS SOFTWARE,", "EVEN IF ADVISED", "OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_BSD = (
    "Redistribution and use in source and binary forms,", "with or without modification,", "are permitted provided that", "the following conditions are met:", "1. Redistributions of source code",
    "must retain the above copyright notice,", "this list of conditions", "and the following disclaimer.", "2. Redistributions in binary form", "must reproduce the above copyright notice,",
    "this list of conditions", "and the following disclaimer", "in the documentation and/or", "other materials provided with the distribution.",
)
_ENDORSE = ("3. Neither the name of", "the copyright holder nor", "the names of its contributors", "may be used to endorse or promote", "products derived from this software", "without specific prior written permission.")
_LATER = (
    "or (at your option) any later version.", "This program is distributed", "in the hope that it will be useful,", "but WITHOUT ANY WARRANTY;", "without even the implied warranty",
    "of MERCHANTABILITY or FITNESS", "FOR A PARTICULAR PURPOSE.",
)


def _gnu(name: str, version: str) -> tuple[str, ...]:
    return ("This program is free software:", "you can redistribute it and/or modify", f"it under the terms of the {name}", "as published by", "the Free Software Foundation,", f"either version {version} of the License,", *_LATER)


def _terms(name: str, version: str) -> tuple[str, ...]:
    return (f"under the terms of the {name}", "as published by the Free Software Foundation,", f"either version {version} of the License, or any later version")


def _later(license_: str, name: str, version: str) -> tuple[Template, ...]:
    phrases = (name, f"either version {version.replace('.', ' ')}", "any later version")
    return (license_, _terms(name, version), phrases), (license_, _gnu(name, version), phrases)


TEMPLATES: tuple[Template, ...] = (
    ("MIT", ("Released under the MIT License",), ("MIT License",)),
    ("MIT", ("Licensed under the MIT License",), ("MIT License",)),
    ("MIT", ("Permission is hereby granted, free of charge,", "to any person obtaining a copy", "of this software and associated documentation files"), ("free of charge", "any person obtaining a copy")),
    (
        "MIT",
        (
            "Permission is hereby granted, free of charge,", "to any person obtaining a copy", "of this software and associated", "documentation files (the \"Software\"),", "to deal in the Software", "without restriction,",
            "including without limitation the rights", "to use, copy, modify, merge, publish,", "distribute, sublicense, and/or sell", "copies of the Software,", "and to permit persons to whom", "the Software is furnished to do so,",
            "subject to the following conditions:", "The above copyright notice", "and this permission notice shall be", "included in all copies", "or substantial portions of the Software.", "THE SOFTWARE", *_WARRANTY,
            "IN NO EVENT SHALL", "THE AUTHORS OR COPYRIGHT HOLDERS", "BE LIABLE FOR ANY CLAIM,", "DAMAGES OR OTHER LIABILITY,", "WHETHER IN AN ACTION OF CONTRACT,", "TORT OR OTHERWISE,", "ARISING FROM, OUT OF", "OR IN CONNECTION WITH THE SOFTWARE",
            "OR THE USE OR OTHER DEALINGS", "IN THE SOFTWARE.",
        ),
        ("free of charge", "any person obtaining a copy"),
    ),
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0",), ("Apache License Version 2 0",)),
    ("Apache-2.0", ("you may not use this file", "except in compliance with the License.", "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0"), ("www apache org licenses", "in compliance with the License")),
    (
        "Apache-2.0",
        (
            "Licensed under the Apache License,", "Version 2.0 (the \"License\");", "you may not use this file", "except in compliance with the License.", "You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law", "or agreed to in writing, software", "distributed under the License", "is distributed on an \"AS IS\" BASIS,", "WITHOUT WARRANTIES OR CONDITIONS", "OF ANY KIND, either express or implied.",
            "See the License for the specific language", "governing permissions and limitations", "under the License.",
        ),
        ("Apache License Version 2 0", "www apache org licenses"),
    ),
    ("GPL-3.0", ("This work is licensed under", "the GNU General Public License, version 3"), ("GNU General Public License version 3",)),
    ("GPL-2.0", ("This work is licensed under", "the GNU General Public License, version 2"), ("GNU General Public License version 2",)),
    *_later("GPL-3.0-or-later", "GNU General Public License", "3"),
    *_later("GPL-2.0-or-later", "GNU General Public License", "2"),
    ("LGPL-3.0", ("licensed under the", "GNU Lesser General Public License, version 3"), ("GNU Lesser General Public License version 3",)),
    *_later("LGPL-3.0-or-later", "GNU Lesser General Public License", "3"),
    *_later("LGPL-2.1-or-later", "GNU Lesser General Public License", "2.1"),
    ("AGPL-3.0", ("licensed under the", "GNU Affero General Public License, version 3"), ("GNU Affero General Public License version 3",)),
    *_later("AGPL-3.0-or-later", "GNU Affero General Public License", "3"),
    ("BSD-3-Clause", (*_BSD, *_ENDORSE, *_DISCLAIMER), ("Redistribution and use in source and binary forms", "endorse or promote")),
    ("BSD-2-Clause", (*_BSD, *_DISCLAIMER), ("Redistribution and use in source and binary forms", "conditions are met")),
    ("BSD", _BSD[:4], ("Redistribution and use in source and binary forms",)),
    ("BSD-3-Clause", ("Licensed under the BSD 3-Clause License",), ("BSD 3 Clause License",)),
    ("BSD-2-Clause", ("Licensed under the BSD 2-Clause License",), ("BSD 2 Clause License",)),
    ("MPL-2.0", ("This Source Code Form is subject to", "the terms of the Mozilla Public License, v. 2.0"), ("Mozilla Public License v 2 0",)),
    (
        "MPL-2.0",
        ("This Source Code Form is subject to", "the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL", "was not distributed with this file,", "You can obtain one at", "http://mozilla.org/MPL/2.0/."),
        ("Mozilla Public License v 2 0", "mozilla org MPL 2 0"),
    ),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0",), ("CC BY 4 0",)),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0",), ("CC BY SA 4 0",)),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0",), ("CC BY NC 4 0",)),
    ("CC-BY-ND-4.0", ("Licensed under CC BY-ND 4.0",), ("CC BY ND 4 0",)),
    ("CC-BY-4.0", ("This work is licensed under", "a Creative Commons Attribution 4.0 International License"), ("Creative Commons Attribution 4 0 International License",)),
    ("CC0-1.0", ("To the extent possible under law,", "the author has waived all copyright", "and related or neighboring rights", "to this work"), ("waived all copyright",)),
    ("ISC", ("Permission to use, copy, modify, and/or", "distribute this software for any purpose", "with or without fee is hereby granted"), ("with or without fee",)),
    (
        "ISC",
        (
            "Permission to use, copy, modify, and/or", "distribute this software for any purpose", "with or without fee is hereby granted,", "provided that the above copyright notice", "and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\"",
            "AND THE AUTHOR DISCLAIMS ALL WARRANTIES", "WITH REGARD TO THIS SOFTWARE", "INCLUDING ALL IMPLIED WARRANTIES", "OF MERCHANTABILITY AND FITNESS.", "IN NO EVENT SHALL THE AUTHOR", "BE LIABLE FOR ANY SPECIAL, DIRECT,",
            "INDIRECT, OR CONSEQUENTIAL DAMAGES", "OR ANY DAMAGES WHATSOEVER", "RESULTING FROM LOSS OF USE, DATA OR PROFITS,", "WHETHER IN AN ACTION OF CONTRACT,", "NEGLIGENCE OR OTHER TORTIOUS ACTION,", "ARISING OUT OF OR IN CONNECTION",
            "WITH THE USE OR PERFORMANCE", "OF THIS SOFTWARE.",
        ),
        ("with or without fee", "DISCLAIMS ALL WARRANTIES"),
    ),
    ("Unlicense", ("This is free and unencumbered software", "released into the public domain"), ("free and unencumbered software",)),
    (
        "Unlicense",
        (
            "This is free and unencumbered software", "released into the public domain.", "Anyone is free to copy, modify, publish,", "use, compile, sell, or distribute this software,", "either in source code form", "or as a compiled binary,", "for any purpose, commercial or non-commercial,",
            "and by any means.",
        ),
        ("free and unencumbered software", "released into the public domain"),
    ),
    ("EPL-2.0", ("This program and the accompanying materials", "are made available under the terms of", "the Eclipse Public License 2.0"), ("Eclipse Public License 2 0",)),
    (
        "Zlib",
        (
            "This software is provided 'as-is',", "without any express or implied warranty.", "In no event will the authors be held liable", "for any damages arising from the use of this software.", "Permission is granted to anyone", "to use this software for any purpose,",
            "including commercial applications,", "and to alter it and redistribute it freely,", "subject to the following restrictions:",
        ),
        ("alter it and redistribute it freely",),
    ),
    (
        "BSL-1.0",
        (
            "Permission is hereby granted, free of charge,", "to any person or organization", "obtaining a copy of the software", "and accompanying documentation", "covered by this license (the \"Software\")", "to use, reproduce, display, distribute,",
            "execute, and transmit the Software,", "and to prepare derivative works of the Software,",
        ),
        ("any person or organization obtaining a copy",),
    ),
)
