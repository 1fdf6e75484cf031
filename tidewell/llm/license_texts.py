"""Licence texts and notices, in their words, with a label and the key phrases that must stand in them.

Each is (label, mandatory phrases, text). Copyright lines are left out, as they differ from file to file.
"""

TEXTS = (
    ("gpl-3", ("gnu general public license version 3",), "This work is licensed under the GNU General Public License version 3"),
    ("all-rights-reserved", ("all rights reserved",), "All rights reserved"),
    (
        "mit", ("permission is hereby granted free of charge",),
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files""",
    ),
    (
        "mit", ("permission is hereby granted free of charge", "the software is provided as is"),
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd", ("redistribution and use in source and binary forms",),
        """Redistribution and use in source and binary forms, with or without modification, are permitted""",
    ),
    (
        "bsd-2", ("redistribution and use in source and binary forms", "this software is provided by the copyright holders and contributors as is"),
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED
        BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
        BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "bsd-3", ("redistribution and use in source and binary forms", "nor the names of its contributors may be used to endorse or promote products"),
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc", ("with or without fee is hereby granted",),
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted""",
    ),
    (
        "isc", ("with or without fee is hereby granted", "the author disclaims all warranties with regard to this software"),
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "zlib", ("altered source versions must be plainly marked as such",),
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
        product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must
        be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or
        altered from any source distribution.""",
    ),
    (
        "unlicense", ("this is free and unencumbered software released into the public domain",),
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
        any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
    ),
    (
        "bsl-1", ("boost software license version 1 0",),
        """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or
        organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
        reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
        permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the
        Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be
        included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
        derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    ),
    (
        "apache-2", ("apache license version 2",),
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License""",
    ),
    (
        "apache-2", ("apache license version 2", "limitations under the license"),
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to
        in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    ),
    (
        "apache-2", ("apache license version 2 0 january 2004", "terms and conditions for use reproduction and distribution"),
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
        DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
        Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that
        is granting the License.""",
    ),
    (
        "gpl", ("terms of the gnu general public license",),
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License""",
    ),
    (
        "gpl-2", ("either version 2 of the license", "gnu general public license for more details"),
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "gpl-3", ("either version 3 of the license", "gnu general public license for more details"),
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "lgpl", ("gnu lesser general public license",),
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
        library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    (
        "agpl-3", ("gnu affero general public license",),
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    ),
    (
        "mpl", ("mozilla public license",),
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    (
        "mpl", ("mozilla public license",),
        """This Source Code Form is subject to the terms of the Mozilla Public License""",
    ),
    (
        "epl-2", ("eclipse public license 2 0",),
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available
        at https://www.eclipse.org/legal/epl-2.0/""",
    ),
    (
        "cc-by", ("creative commons attribution 4 0 international license",),
        """This work is licensed under a Creative Commons Attribution 4.0 International License""",
    ),
    (
        "cc-by-sa", ("creative commons attribution sharealike 4 0 international license",),
        """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License""",
    ),
    (
        "cc-by-nc", ("creative commons attribution noncommercial 4 0 international license",),
        """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License""",
    ),
    (
        "cc-by-nd", ("creative commons attribution noderivatives 4 0 international license",),
        """This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License""",
    ),
    (
        "cc0", ("cc0 1 0 universal",),
        """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to
        the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law. CC0 1.0
        Universal""",
    ),
    (
        "wtfpl", ("you just do what the fuck you want to",),
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as
        long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND
        MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
    ),
    # How the long licences themselves begin, after their copyright lines.
    (
        "gpl-3", ("the gnu general public license is a free copyleft license",),
        """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The
        GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software
        and other practical works are designed to take away your freedom to share and change the works.""",
    ),
    (
        "agpl-3", ("the gnu affero general public license is a free copyleft license",),
        """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The
        GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to
        ensure cooperation with the community in the case of network server software.""",
    ),
    (
        "gpl-2", ("this general public license applies to most of the free software foundation",),
        """Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The
        licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public
        License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its
        users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose
        authors commit to using it.""",
    ),
    (
        "lgpl", ("this license the lesser general public license applies to some",),
        """By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure
        the software is free for all its users. This license, the Lesser General Public License, applies to some specially designated
        software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.""",
    ),
    (
        "lgpl", ("this version of the gnu lesser general public license incorporates",),
        """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public
        License, supplemented by the additional permissions listed below.""",
    ),
    (
        "mpl", ("mozilla public license version 2 0",),
        """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes
        to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others
        (if any) used by a Contributor and that particular Contributor's Contribution.""",
    ),
    (
        "epl-2", ("provided under the terms of this eclipse public license",),
        """Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY
        USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.""",
    ),
)
