"""Public license texts and notices that the scan looks for.

Fixed values: the words of the licenses are those that their authors published; copyright lines are left out.
A template is its label, its text, word pairs that a block must have and word pairs that it must not have,
which tell it from licenses with nearly the same words.
"""

from __future__ import annotations

MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

ZERO_BSD = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_2, BSD_3 = _BSD_HEAD + _BSD_TAIL, _BSD_HEAD + _BSD_THIRD + _BSD_TAIL

ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not
be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""

BOOST = """
Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any
person or organization obtaining a copy of the software and accompanying documentation covered by this license (the
"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING
THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

UNLICENSE = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

WTFPL = """
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004. Everyone is permitted to copy and distribute
verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO
WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just
DO WHAT THE FUCK YOU WANT TO."""

POSTGRESQL = """
Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee,
and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and
the following two paragraphs appear in all copies. IN NO EVENT SHALL THE AUTHORS BE LIABLE TO ANY PARTY FOR DIRECT,
INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS
SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE AUTHORS HAVE BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. THE AUTHORS
SPECIFICALLY DISCLAIM ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND THE AUTHORS HAVE NO
OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS."""

APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""


def _gnu(name: str, version: str) -> str:
    """The notice that programs under one of the GNU licenses carry."""
    return f"""
This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You
should have received a copy of the GNU {name} along with this program. If not, see http://www.gnu.org/licenses/."""


MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

CC0_NOTICE = """
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work
under the CC0 1.0 Universal Public Domain Dedication."""

_GPL = "GNU General Public License"
_OTHER_GNU = ("affero general", "lesser general")

#: (label, text, word pairs a block must have, word pairs it must not have).
TEMPLATES = (
    ("0bsd", ZERO_BSD, ("without fee", "author disclaims"), ("permission notice",)),
    ("agpl-3.0", _gnu("Affero General Public License", "3"), ("affero general", "version 3"), ()),
    ("agpl-3.0", "GNU Affero General Public License version 3", ("affero general", "version 3"), ()),
    ("apache-2.0", APACHE_NOTICE, ("apache license", "version 2"), ()),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2"), ()),
    ("bsd-2-clause", BSD_2, ("binary forms",), ("endorse or",)),
    ("bsd-3-clause", BSD_3, ("binary forms", "endorse or"), ()),
    ("bsl-1.0", BOOST, ("boost software",), ()),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by", "by 4"), ()),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License", ("commons attribution", "attribution 4"), ()),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("by nc", "nc 4"), ()),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial", "noncommercial 4"), ()),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", ("by nc", "nc nd"), ()),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("by nc", "nc sa"), ()),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("by nd", "nd 4"), ()),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("by sa", "sa 4"), ()),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike", "sharealike 4"), ()),
    ("cc0-1.0", CC0_NOTICE, ("waived all", "cc0 1"), ()),
    ("gpl-2.0", _gnu("General Public License", "2"), ("gnu general", "version 2"), _OTHER_GNU),
    ("gpl-2.0", f"{_GPL} version 2", ("gnu general", "version 2"), _OTHER_GNU),
    ("gpl-3.0", _gnu("General Public License", "3"), ("gnu general", "version 3"), _OTHER_GNU),
    ("gpl-3.0", f"{_GPL} version 3", ("gnu general", "version 3"), _OTHER_GNU),
    ("isc", ISC, ("without fee", "permission notice"), ()),
    ("lgpl-2.1", _gnu("Lesser General Public License", "2.1"), ("lesser general", "2 1"), ()),
    ("lgpl-2.1", "GNU Lesser General Public License version 2.1", ("lesser general", "2 1"), ()),
    ("lgpl-3.0", _gnu("Lesser General Public License", "3"), ("lesser general", "version 3"), ()),
    ("lgpl-3.0", "GNU Lesser General Public License version 3", ("lesser general", "version 3"), ()),
    ("mit", MIT, ("substantial portions",), ()),
    ("mit", "the MIT License", ("mit license",), ()),
    ("mpl-2.0", MPL_NOTICE, ("mozilla public",), ()),
    ("postgresql", POSTGRESQL, ("written agreement",), ()),
    ("unlicense", UNLICENSE, ("unencumbered software",), ()),
    ("wtfpl", WTFPL, ("verbatim or",), ()),
    ("zlib", ZLIB, ("plainly marked",), ()),
)
