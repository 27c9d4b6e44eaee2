"""Licence notices and bodies as word sequences: fixed values, from the licences' public texts as the
SPDX licence list gives them, without marks and in lower case. Of the long licences their notices and
the passages that tell versions apart stand here; whole texts can be given to licenses.find_licenses().

Each: label, words, phrases that must stand in them.
"""

_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_BSD_OPENING = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_CLOSING = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"
)
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"

BODIES = [
    (
        "mit-full",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        f"{_AS_IS} and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        ["deal in the software without restriction", "all copies or substantial portions of the software", "merchantability fitness for a particular purpose and noninfringement"],
    ),
    (
        "isc-full",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        ["with or without fee is hereby granted provided", "the author disclaims all warranties"],
    ),
    (
        "0bsd-full",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ["is hereby granted the software is provided as is", "the author disclaims all warranties"],
    ),
    ("bsd-2-full", f"{_BSD_OPENING} {_BSD_CLOSING}", ["following conditions are met", "provided with the distribution this software is provided by"]),
    (
        "bsd-3-full",
        f"{_BSD_OPENING} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_CLOSING}",
        ["following conditions are met", "endorse or promote products derived from this software"],
    ),
    (
        "zlib-full",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
        ["alter it and redistribute it freely", "altered source versions must be plainly marked"],
    ),
    (
        "unlicense-full",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        ["free and unencumbered software", "by any means"],
    ),
    (
        "bsl-1-full",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ["any person or organization obtaining", "prepare derivative works of the software"],
    ),
    (
        "wtfpl-2-full",
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed "
        "do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to",
        ["as long as the name is changed", "you just do what"],
    ),
    (
        "apache-2-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ["apache license version 2 0", "distributed on an as is basis"],
    ),
    (
        "apache-2-grant",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license "
        "to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
        ["each contributor hereby grants to you a perpetual", "publicly display publicly perform sublicense"],
    ),
    ("gpl-2-notice", "this program is free software " + _GNU.format("general public license", 2), ["gnu general public license as published", "either version 2 of the license"]),
    ("gpl-3-notice", "this program is free software " + _GNU.format("general public license", 3), ["gnu general public license as published", "either version 3 of the license"]),
    ("lgpl-2-1-notice", "this library is free software " + _GNU.format("lesser general public license", "2 1"), ["gnu lesser general public license", "either version 2 1 of the license"]),
    ("lgpl-3-notice", "this library is free software " + _GNU.format("lesser general public license", 3), ["gnu lesser general public license", "either version 3 of the license"]),
    ("agpl-3-notice", "this program is free software " + _GNU.format("affero general public license", 3), ["gnu affero general public license", "either version 3 of the license"]),
    (
        "gpl-1-full",
        "the license agreements of most software companies try to keep users at the mercy of those companies by contrast our general public license is intended to guarantee your freedom to share and change free software "
        "to make sure the software is free for all its users",
        ["try to keep users at the mercy", "by contrast our general public license"],
    ),
    (
        "gpl-2-full",
        "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software "
        "to make sure the software is free for all its users this general public license applies to most of the free software foundation s software and to any other program whose authors commit to using it",
        ["licenses for most software are designed", "the gnu general public license is intended", "this general public license applies to most"],
    ),
    (
        "lgpl-2-full",
        "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses are intended to guarantee your freedom to share and change free software "
        "to make sure the software is free for all its users this license the library general public license applies to some specially designated free software foundation software and to any other libraries whose authors decide to use it",
        ["licenses for most software are designed", "this license the library general public license applies"],
    ),
    (
        "lgpl-2-1-full",
        "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licenses are intended to guarantee your freedom to share and change free software "
        "to make sure the software is free for all its users this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
        ["licenses for most software are designed", "this license the lesser general public license applies"],
    ),
    (
        "lgpl-3-full",
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
        ["incorporates the terms and conditions of version 3", "supplemented by the additional permissions listed below"],
    ),
    (
        "gfdl-1-full",
        "the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom to assure everyone the effective freedom to copy and redistribute it "
        "with or without modifying it either commercially or noncommercially secondarily this license preserves for the author and publisher a way to get credit for their work",
        ["other functional and useful document free", "the author and publisher a way to get credit"],
    ),
    (
        "gpl-3-full",
        "the gnu general public license is a free copyleft license for software and other kinds of works the licenses for most software and other practical works are designed to take away your freedom "
        "to share and change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program",
        ["free copyleft license for software", "all versions of a program"],
    ),
    (
        "agpl-3-full",
        "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
        ["gnu affero general public license", "in the case of network server software"],
    ),
    (
        "mpl-2-notice",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["mozilla public license v 2 0", "not distributed with this file"],
    ),
    (
        "mpl-1-1-full",
        "commercial use means distribution or otherwise making the covered code available to a third party 1 1 contributor means each entity that creates or contributes to the creation of modifications "
        "1 2 contributor version means the combination of the original code prior modifications used by a contributor and the modifications made by that particular contributor",
        ["otherwise making the covered code available to a third party", "the combination of the original code prior modifications"],
    ),
    (
        "mpl-2-full",
        "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software 1 2 contributor version means the combination of the contributions of others if any "
        "used by a contributor and that particular contributor s contribution",
        ["contributes to the creation of or owns covered software", "that particular contributor s contribution"],
    ),
    (
        "artistic-1-full",
        "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package "
        "while giving the users of the package the right to use and distribute the package in a more or less customary fashion plus the right to make reasonable modifications",
        ["some semblance of artistic control", "in a more or less customary fashion"],
    ),
    (
        "cc0-1-legal-code",
        "the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined below upon the creator and subsequent owner s each and all an owner "
        "of an original work of authorship and or a database each a work certain owners wish to permanently relinquish those rights to a work",
        ["automatically confer exclusive copyright and related rights", "wish to permanently relinquish those rights"],
    ),
    (
        "cc0-1-full",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights",
        ["dedicated the work to the public domain", "related and neighboring rights"],
    ),
    ("cc-by-4", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-sa-4", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4 0 international"]),
    ("cc-by-nc-4", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4 0 international"]),
    ("cc-by-nd-4", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["attribution noderivatives 4 0 international"]),
    ("cc-by-nc-sa-4", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["attribution noncommercial sharealike 4 0"]),
    ("cc-by-sa-3", "this work is licensed under the creative commons attribution sharealike 3 0 unported license", ["attribution sharealike 3 0 unported"]),
]
