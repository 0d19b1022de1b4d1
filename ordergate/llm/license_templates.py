"""Wordings and templates of the license scan.

Markup, as in public license lists: ``<<beginOptional>> ... <<endOptional>>`` may be
left out (they nest); ``<<var;match=...>>`` stands for replaceable text, either any
``least..most`` words or one of several wordings set apart by ``|``. Everything else is
mandatory. Only words count: case, punctuation and line breaks don't.
"""

# Phrases of the contract and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Public license texts and notices, as templates.
TEMPLATES = [
    ("MIT-text", """<<beginOptional>>The MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>>
<<beginOptional>>Copyright <<var;match=0..30>><<endOptional>>
Permission is hereby granted, free of charge, to any person obtaining a copy of
<<var;match=this software and associated documentation files|this software and associated documentation>>
(the "<<var;match=1..2>>"), to deal in the <<var;match=1..2>> without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the <<var;match=1..2>>, and to permit persons to whom the
<<var;match=1..2>> is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the
<<var;match=1..2>>. <<var;match=1..3>> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=1..20>> BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE <<var;match=1..2>> OR THE USE OR OTHER DEALINGS IN THE <<var;match=1..2>>."""),
    ("ISC-text", """<<beginOptional>>ISC License<<endOptional>> <<beginOptional>>Copyright <<var;match=0..30>><<endOptional>>
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND <<var;match=1..10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;match=1..10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: <<var;match=0..1>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<var;match=0..1>> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. <<var;match=0..1>> Neither the name of <<var;match=1..20>> nor the names of <<var;match=1..5>> contributors may be used
to endorse or promote products derived from this software without specific prior written permission."""),
    ("BSD-2-Clause-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: <<var;match=0..1>> Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. <<var;match=0..1>> Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. <<beginOptional>><<var;match=0..20>><<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;match=1..20>> "AS IS" AND ANY
EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED."""),
    ("Apache-2.0-notice", """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>
<<beginOptional>>; you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<var;match=1..12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.<<endOptional>>"""),
    ("GPL-3.0-only-notice", """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License,
<<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 3"""),
    ("GPL-2.0-only-notice", """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License,
<<beginOptional>>as published by the Free Software Foundation<<endOptional>> version 2"""),
    ("GPL-or-later-notice", """This program is free software<<var;match=|:|;>> you can redistribute it and/or modify it under the terms of
the GNU <<beginOptional>><<var;match=Affero|Lesser|Library>><<endOptional>> General Public License as published by the Free Software
Foundation, either version <<var;match=1..2>> of the License, or (at your option) any later version."""),
    ("MPL-2.0-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at <<var;match=1..6>>"""),
    ("CC-notice", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution
<<beginOptional>>Non<<beginOptional>>-<<endOptional>>Commercial<<endOptional>>
<<beginOptional>>ShareAlike<<endOptional>> <<beginOptional>>NoDerivatives<<endOptional>> <<var;match=1..2>>
<<var;match=International|Unported|Generic>> License"""),
    ("CC-BY-NC-tag", """licensed under <<beginOptional>>a<<endOptional>> CC BY-NC <<var;match=2 0|2 5|3 0|4 0>>"""),
    ("Zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("Unlicense-text", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("SPDX-MIT-tag", "SPDX-License-Identifier: MIT"),
    ("SPDX-Apache-2.0-tag", "SPDX-License-Identifier: Apache-2.0"),
    ("all-rights-reserved", "<<beginOptional>>Copyright <<var;match=0..12>><<endOptional>> All rights reserved"),
]
