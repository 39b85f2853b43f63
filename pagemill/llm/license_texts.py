"""License wordings with their markup: ``[[...]]`` is optional, ``{{n}}`` stands for up to n replaceable words.

Fixed values: the words of the licenses as published, lower-cased, without punctuation.
"""

from __future__ import annotations

#: Notices that name a license.
NOTICES = {
    "apache-2.0": ["[[this work is]] licensed under the apache license version 2 0"],
    "gpl-3.0": ["[[this {{2}} is]] [[free software]] licensed under the gnu general public license version 3 [[0]] [[or later]]",
                "under the terms of the gnu general public license as published by the free software foundation "
                "either version 3 [[of the license]] [[or at your option any later version]]"],
    "gpl-2.0": ["[[this {{2}} is]] licensed under the gnu general public license version 2 [[0]] [[or later]]",
                "under the terms of the gnu general public license as published by the free software foundation "
                "either version 2 [[of the license]] [[or at your option any later version]]"],
    "cc-by-4.0": ["[[this {{2}} is]] licensed under cc by 4 0",
                  "licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc-4.0": ["[[this {{2}} is]] licensed under cc by nc 4 0"],
    "cc-by-sa-4.0": ["[[this {{2}} is]] licensed under cc by sa 4 0"],
    "mit": ["[[this {{2}} is]] [[released]] [[licensed]] under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the {{1}} to deal in the {{1}} without restriction"],
    "bsd-3-clause": ["redistribution and use in source and binary forms with or without modification are permitted "
                     "provided that the following conditions are met {{80}} neither the name of {{12}} nor the names "
                     "of its contributors may be used to endorse or promote products"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"],
}

_BSD_BEGIN = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list "
    "of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution")
_BSD_NAMES = (
    "[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission")
_BSD_END = (
    "this software is provided by {{8}} as is and any express or implied warranties including but not limited to the "
    "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be "
    "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused and "
    "on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage")

#: Whole license texts, after the copyright line.
TEXTS = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the {{1}} to deal in the {{1}} without restriction including without limitation the rights "
           "to use copy modify merge publish distribute sublicense and or sell copies of the {{1}} and to permit persons to "
           "whom the {{1}} is furnished to do so subject to the following conditions the above copyright notice and this "
           "permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of "
           "the {{1}} the {{1}} is provided as is without warranty of any kind express or implied including but not limited "
           "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall "
           "{{6}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
           "arising from out of or in connection with the {{1}} or the use or other dealings in the {{1}}",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
           "granted provided that the above copyright notice and this permission notice appear in all copies the software "
           "is provided as is and {{4}} disclaims all warranties with regard to this software including all implied "
           "warranties of merchantability and fitness in no event shall {{4}} be liable for any special direct indirect or "
           "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
           "of contract negligence or other tortious action arising out of or in connection with the use or performance of "
           "this software",
    "bsd-2-clause": f"{_BSD_BEGIN} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_BEGIN} {_BSD_NAMES} {_BSD_END}",
    "zlib": "this software is provided as is without any express or implied warranty in no event will {{4}} be held liable "
            "for any damages arising from the use of this software permission is granted to anyone to use this software for "
            "any purpose including commercial applications and to alter it and redistribute it freely subject to the "
            "following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that "
            "you wrote the original software if you use this software in a product an acknowledgment in the product "
            "documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as "
            "such and must not be misrepresented as being the original software [[3]] this notice may not be removed or "
            "altered from any source distribution",
}

TEMPLATES = {label: NOTICES.get(label, []) + ([TEXTS[label]] if label in TEXTS else [])
             for label in sorted({*NOTICES, *TEXTS})}
