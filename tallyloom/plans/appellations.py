"""Keyword groups available to logic rules."""

# Forms of address that identify a person's sex or role.
APPELLATIONS = {
    "male": ["先生", "父", "爸", "爺", "阿公", "男", "丈夫", "兄", "哥", "弟", "兒子", "叔", "舅",
             "老公", "祖父", "婿", "公公", "岳父"],
    "female": ["太太", "老婆", "妻", "女", "小姐", "姊", "姐", "妹", "姨", "姑", "女兒", "母", "媽",
               "孫女", "媳", "阿嬤", "婆婆", "岳母", "夫人"],
    "spouse": ["配偶", "老婆", "太太", "夫人", "妻", "先生", "老公", "丈夫", "夫"],
    "participant": ["自己", "本人", "己", "受訪者"],
}
