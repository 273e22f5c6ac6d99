"""Public licence texts, usual one-line notices, and spellings that count as equal."""

from importlib.resources import files

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_MIT_BODY = f"""{_MIT_GRANT}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_AS_IS}"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""



def _long(name: str, *ends: str) -> tuple[tuple[str, str], ...]:
    """The whole text, and what precedes its appendix, with and without the line that ends the terms."""
    text = files(__package__).joinpath("texts", f"{name}.txt").read_text()
    return ((name, text), *((name, text[: text.rindex(end)]) for end in ends))


_END = "END OF TERMS AND CONDITIONS"
_ISC = f"Copyright (c) 2024 holder\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"
_BSD_2_CLAUSE = "\n\n".join(("Copyright (c) 2024, holder", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_AS_IS))
_BSD_3_CLAUSE = "\n\n".join(("Copyright (c) 2024, holder", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_AS_IS))

LICENSES = (
    ("MIT", f"MIT License\n\nCopyright (c) 2024 holder\n\n{_MIT_BODY}"),
    ("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2024 holder\n\n{_MIT_BODY}"),
    ("MIT", f"Copyright (c) 2024 holder\n\n{_MIT_BODY}"),
    ("MIT-0", f"MIT No Attribution\n\nCopyright 2024 holder\n\n{_MIT_GRANT}.\n\n{_AS_IS}"),
    ("ISC", f"ISC License\n\n{_ISC}"),
    ("0BSD", f"BSD Zero Clause License\n\nCopyright (c) 2024 holder\n\n{_ISC_GRANT}.\n\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_2_CLAUSE}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_3_CLAUSE}"),
    ("MIT-0", f"Copyright 2024 holder\n\n{_MIT_GRANT}.\n\n{_AS_IS}"),
    ("ISC", _ISC),
    ("0BSD", f"Copyright (c) 2024 holder\n\n{_ISC_GRANT}.\n\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", _BSD_2_CLAUSE),
    ("BSD-3-Clause", _BSD_3_CLAUSE),
    *_long("Apache-2.0", _END, "APPENDIX:"),
    *_long("GPL-2.0", _END, "How to Apply"),
    *_long("GPL-3.0", _END, "How to Apply"),
    *_long("LGPL-2.1", _END, "How to Apply"),
    *_long("LGPL-3.0"),
    *_long("MPL-2.0", "Exhibit A - "),
    *_long("CC0-1.0"),
    ("Unlicense", _UNLICENSE),
    ("Zlib", f"zlib License\n\nCopyright (c) 2024 holder\n\n{_ZLIB}"),
    ("Zlib", f"Copyright (c) 2024 holder\n\n{_ZLIB}"),
)

NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
)

SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("recognise", "recognize"),
    ("favour", "favor"),
    ("per cent", "percent"),
)
